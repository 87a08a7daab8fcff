import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework import catalogue, errors, kernels, stacks
from latticework.functions import vectors as fv
from latticework.operators import cells, differentiation, iterative, optimization, pairwise, sparse, stats, tall
from latticework.plans import reporting
from latticework.streaming import moments


def rows(spark, values):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], "row_id long, v array<double>")


def test_vector_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<double>, b array<double>")
    out = df.select(fv.dot("a", "b"), fv.l2_norm("a"), fv.cosine_distance("a", "a"), fv.l2_distance("a", "b")).head()
    assert out[0] == 32 and np.isclose(out[1], 14**0.5) and abs(out[2]) < 1e-12 and np.isclose(out[3], 27**0.5)
    c = df.select(fv.complex_vector("a", "b").alias("x"), fv.complex_vector("b", "a").alias("y")).select(fv.dot_hermitian("x", "y"), fv.cosine_similarity_complex("x", "y")).head()
    want = np.vdot(np.array([1, 2, 3]) + 1j * np.array([4, 5, 6]), np.array([4, 5, 6]) + 1j * np.array([1, 2, 3]))
    assert np.isclose(c[0]["re"], want.real) and np.isclose(c[0]["im"], want.imag)


@pytest.mark.parametrize(("a", "b", "kind"), [([], [1.0], errors.EmptyInput), ([1.0], [1.0, 2.0], errors.DimensionMismatch), (None, [1.0], errors.EmptyInput)])
def test_vector_refusals(spark, a, b, kind):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    with pytest.raises(Exception) as e:  # noqa: PT011
        df.select(fv.dot("a", "b")).collect()
    assert isinstance(errors.from_spark(e.value), kind)


def test_pairwise(spark):
    x, y = np.random.default_rng(1).normal(size=(2, 7, 3))
    for f, want in ((pairwise.pairwise_l2_distance, np.linalg.norm(x[:, None] - y[None], axis=2)), (pairwise.pairwise_cosine_similarity, (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)))):
        out = f(rows(spark, x), rows(spark, y), block=3).collect()
        assert len(out) == 49 and all(np.isclose(r[2], want[r[0], r[1]]) for r in out)


def test_pairs_of_blocks_are_not_shuffled(spark):
    x = np.random.default_rng(3).normal(size=(40, 3))
    x[20:30] = x[:10]  # ties
    df = rows(spark, x)
    for other in (df, rows(spark, x)):
        out = pairwise.pairwise_l2_distance(df, other, block=7)
        assert "CartesianProduct" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan
        assert len({(r[0], r[1]) for r in out.collect()}) == 1600
        top = {(r["left_id"], r["rank"]): r["right_id"] for r in pairwise.cosine_top_k(df, other, 5, block=7, digits=9).collect()}
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        near = np.round(unit @ unit.T, 9)
        for i in range(40):
            want = sorted((j for j in range(40) if j != i), key=lambda j: (-near[i, j], j))[:5]
            assert [top[i, n] for n in range(1, 6)] == want


def test_cells_keep_going_after_a_bad_matrix(spark):
    df = spark.createDataFrame([(1, (2, 2, [4.0, 1.0, 2.0, 3.0]), [1.0, 2.0]), (2, (2, 2, [1.0, 2.0, 2.0, 4.0]), [1.0, 2.0]), (3, None, None)], f"id int, m {cells.MATRIX}, b array<double>")
    out = {r["id"]: r for r in cells.apply(df, "lu_solve", "m", "b").collect()}
    assert np.allclose(out[1]["result"]["x"], np.linalg.solve([[4, 1], [2, 3]], [1, 2]))
    assert out[2]["error"] == "SingularMatrix" and out[2]["result"] is None and out[3]["error"] == "EmptyInput"


def test_all_cell_operators_run(spark):
    m = spark.createDataFrame([((2, 2, [4.0, 1.0, 1.0, 3.0]), (2, 2, [2.0, 0.0, 0.0, 1.0]), [1.0, 2.0], 0.5, 1)], f"a {cells.MATRIX}, b {cells.MATRIX}, v array<double>, t double, n int")
    extra = {"lu_solve": "v", "cholesky_solve": "v", "solve_lower": "v", "solve_upper": "v", "solve_lower_complex": "v", "solve_upper_complex": "v", "least_squares": "v", "eigen_generalized": "b", "eigen_generalized_spd": "b", "svd_with_tolerance": "t", "svd_truncated": "n", "matrix_power": "t", "lyapunov": "b", "qr_reconstruct": "b", "qr_reconstruct_complex": "b"}
    for name in cells.OPERATORS:
        args = ["a", "b", "a"] if name == "sylvester" else ["a", "v", "b"] if name.startswith("svd_reconstruct") else ["a", extra[name]] if name in extra else ["a"]
        out = cells.apply(m, name, *args).head()
        assert out["error"] is None and out["result"] is not None, name


def test_statistics(spark):
    x = np.random.default_rng(2).normal(size=(40, 3))
    x[:, 2] = 7
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    cov = {(r[0], r[1]): r[2] for r in stats.covariance_matrix(df, ["a", "b", "c"]).collect()}
    assert np.isclose(cov["a", "b"], np.cov(x.T)[0, 1])
    cor = {(r[0], r[1]): r[2] for r in stats.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert cor["c", "c"] == 0 and np.isclose(cor["a", "a"], 1)
    assert stats.column_means(df.limit(0), ["a"]).head()[0] == 0
    with pytest.raises(errors.InvalidInput):
        stats.covariance_matrix(df.limit(1), ["a"])
    with pytest.raises(errors.EmptyInput):
        stats.covariance_matrix(df.limit(0), ["a"])
    fit = stats.linear_regression(df.withColumn("y", 2 * F.col("a") - F.col("b") + 5), ["a", "b"], "y")
    assert np.allclose(fit.coefficients, [5, 2, -1]) and np.isclose(fit.r_squared, 1)
    with pytest.raises(errors.SingularMatrix):
        stats.linear_regression(df, ["a", "a"], "b")


def test_components_and_tall_factors(spark):
    x = np.random.default_rng(3).normal(size=(50, 4)) * [3, 2, 1, 0.5] + 1
    found = stats.pca(rows(spark, x), 2)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(found.explained_variance, values[:2]) and np.isclose(found.explained_variance_ratio.sum(), 1)
    back = rows(spark, x).select("row_id", "v", found.transform(F.col("v")).alias("s")).select("row_id", "s", found.inverse_transform(F.col("s")).alias("b")).orderBy("row_id").collect()
    centered = x - x.mean(0)
    want = centered @ found.components.T @ found.components + x.mean(0)
    assert np.allclose([r["b"] for r in back], want)
    out = tall.svd(rows(spark, x))
    assert np.allclose(out.singular_values, np.linalg.svd(x, compute_uv=False))
    u = np.array([r["u"] for r in out.u.orderBy("row_id").collect()])
    assert np.allclose((u * out.singular_values) @ out.vt, x)
    q, r = tall.qr(rows(spark, x))
    assert np.allclose(np.array([v["q"] for v in q.orderBy("row_id").collect()]) @ r, x)
    b = tall.least_squares(rows(spark, x).withColumn("y", F.col("v")[0] * 2 - F.col("v")[3]))
    assert np.allclose(b, [2, 0, 0, -1])


def system(spark, n=12):
    a = 4 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    x = np.arange(n) / 3 - 1
    coo = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "i long, j long, v double")
    return a, x, coo, spark.createDataFrame([(i, float(v)) for i, v in enumerate(a @ x)], "i long, b double")


def test_sparse(spark):
    a, x, coo, b = system(spark)
    for solve in (sparse.jacobi_solve, sparse.gauss_seidel_solve, iterative.conjugate_gradient, iterative.gmres):
        out = {r[0]: r[1] for r in solve(coo, b, 12).collect()}
        assert np.allclose([out[i] for i in range(12)], x, atol=1e-8)
    # rows read again in each sweep
    out = {r[0]: r[1] for r in sparse.gauss_seidel_solve(coo, b, 12, tolerance=1e-2, kept=0).collect()}
    assert np.allclose([out[i] for i in range(12)], x, atol=1e-1)
    skew = spark.createDataFrame([(0, 1, 2.0), (1, 0, -1.0), (1, 1, 3.0)], "i long, j long, v double")
    some = spark.createDataFrame([(0, 4.0), (1, 5.0)], "i long, b double")
    assert np.allclose([r["x"] for r in iterative.gmres(skew, some, 2).orderBy("i").collect()], [1, 2])
    minus = coo.withColumn("v", -F.col("v"))
    with pytest.raises(errors.NotPositiveDefinite):
        iterative.conjugate_gradient(minus, b, 12)
    with pytest.raises(errors.DimensionMismatch):
        iterative.gmres(coo, b, 11)
    with pytest.raises(errors.SingularMatrix):
        sparse.jacobi_solve(skew, some, 2)
    with pytest.raises(errors.InvalidInput):
        sparse.validate(coo, 3, 3)
    doubled = coo.unionByName(coo)
    csr = {r["i"]: r for r in sparse.to_csr(doubled).collect()}
    assert csr[0]["cols"] == [0, 1] and csr[0]["vals"] == [8.0, -2.0]
    ends = {r["i"]: (r["begin"], r["end"]) for r in sparse.row_pointers(coo.filter("i <> 1"), 12).collect()}
    assert ends[0] == (0, 2) and ends[1] == (2, 2) and ends[2] == (2, 5)
    y = {r["i"]: r["y"] for r in sparse.matvec(coo.filter("i <> 1"), spark.createDataFrame([(j, 1.0) for j in range(12)], "j long, x double"), 12).collect()}
    assert y[1] == 0 and y[0] == 3


def test_gmres_stops_with_a_large_right_side(spark, monkeypatch):
    """The estimate of the residual falls below the tolerance also where that is near the rounding of the right side's norm."""
    _, _, coo, b = system(spark, 80)
    x = np.arange(80) / 3 - 1
    steps, kept = [], iterative.materialize
    monkeypatch.setattr(iterative, "materialize", lambda df, label, **how: steps.append(label) or kept(df, label, **how))
    monkeypatch.setattr(iterative, "BLOCK", 32)
    b = b.withColumn("b", F.col("b") * 100)
    out = {r["i"]: r["x"] for r in iterative.gmres(coo, b, 80).collect()}
    assert np.allclose([out[i] for i in range(80)], 100 * x, atol=1e-8)
    assert steps.count("krylov") < 40


def test_compressed_rows(spark):
    entries = spark.createDataFrame([(0, 1, 5.0), (1, 0, 6.0), (2, 2, 7.0)], "k long, j long, v double")
    pointers = lambda p: spark.createDataFrame(list(enumerate(p)), "i long, pointer long")
    good = sparse.from_csr(pointers([0, 1, 1, 3]), entries, 3, 3)
    assert sorted(map(tuple, good.collect())) == [(0, 1, 5.0), (2, 0, 6.0), (2, 2, 7.0)]
    assert sparse.from_csr(pointers([0, 0, 0]), entries.limit(0), 2, 2).count() == 0
    # too short, not from 0, not up to the end, falling, column out of range
    for p, n, m in (([0, 1], 2, 3), ([1, 1, 1, 3], 3, 3), ([0, 1, 1, 2], 3, 3), ([0, 2, 1, 3], 3, 3), ([0, 1, 1, 3], 3, 2)):
        with pytest.raises(errors.InvalidInput):
            sparse.from_csr(pointers(p), entries, n, m)
    with pytest.raises(errors.EmptyInput):
        sparse.from_csr(pointers([0]), entries, 0, 3)


def test_numbers_far_from_zero(spark):
    rng = np.random.default_rng(4)
    x = 1e8 + rng.normal(size=(1000, 2)) * [2, 1]
    found = stats.pca(rows(spark, x))
    centred = x - x.mean(0)
    assert np.allclose(found.explained_variance, np.linalg.eigvalsh(centred.T @ centred / 999)[::-1], rtol=1e-6)
    flat = np.outer(rng.normal(size=40), [1.0, 2.0, 3.0])
    out = tall.svd(rows(spark, flat))
    u = np.array([r["u"] for r in out.u.orderBy("row_id").collect()])
    assert (out.singular_values[1:] == 0).all() and (u[:, 1:] == 0).all() and np.isclose(np.linalg.norm(u[:, 0]), 1)
    small = np.diag([1.0, 1e-9, 1e-3])
    assert np.allclose(tall.svd(rows(spark, small)).singular_values, [1, 1e-3, 1e-9], rtol=1e-6)


def test_many_partitions_are_merged_in_a_tree(spark):
    x = np.random.default_rng(6).normal(size=(300, 3))
    r = tall.tsqr(rows(spark, x).repartition(100))
    assert np.allclose(r.T @ r, x.T @ x)


@pytest.mark.parametrize("name", ["lu_decompose", "lu_solve", "inverse", "determinant", "log_determinant", "cholesky_decompose", "cholesky_solve", "cholesky_inverse", "solve_lower", "solve_upper", "qr_decompose", "qr_reduced", "gram_schmidt", "least_squares", "eigen_symmetric", "svd_decompose", "svd_condition_number", "pseudo_inverse", "polar", "matrix_exp_eigen", "matrix_log_eigen", "matrix_sign"])
def test_stacks_equal_single_matrices(name):
    """Of good, singular, indefinite, not symmetric, not finite, empty and wide matrices."""
    rng = np.random.default_rng(7)
    spd = [b @ b.T + np.eye(4) for b in rng.normal(size=(3, 4, 4))]
    mats = [*rng.normal(size=(3, 4, 4)), *spd, -spd[0], np.zeros((4, 4)), np.ones((4, 4)), np.full((4, 4), np.nan), rng.normal(size=(5, 3)), rng.normal(size=(3, 5)), np.array([[2.0]])]
    schema = f"m {cells.MATRIX}, b array<double>"
    data = [{"m": {"nrows": m.shape[0], "ncols": m.shape[1], "values": m.reshape(-1).tolist()}, "b": list(range(1, len(m) + 1))} for m in mats]
    data += [{"m": None, "b": [1.0]}, {"m": {"nrows": 2, "ncols": 2, "values": [1.0, None, 2.0, 3.0]}, "b": [1.0, 2.0]}, {"m": {"nrows": 2, "ncols": 2, "values": [1.0]}, "b": [1.0, 2.0]}, {"m": {"nrows": 2, "ncols": 2, "values": [1.0, 0, 0, 1]}, "b": None}]
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    batch = pa.RecordBatch.from_pylist(data, to_arrow_schema(T._parse_datatype_string(schema)))
    kernel, fields, stacked = cells.OPERATORS[name]
    count = 2 if name in ("lu_solve", "cholesky_solve", "solve_lower", "solve_upper", "least_squares") else 1
    load = lambda: [cells._loader(batch.column(i)) for i in range(count)]
    one, codes = cells._solved(load(), batch.num_rows, kernel, None, {})
    many, same = cells._solved(load(), batch.num_rows, kernel, stacked, {})
    assert codes == same and sum(c is None for c in codes) >= 3
    for x, y in zip(one, many, strict=True):
        assert (x is None) == (y is None)
        if x is not None and name not in ("svd_decompose", "eigen_symmetric"):  # vectors of equal values may differ
            assert all(np.allclose(p, q, atol=1e-9, equal_nan=True) for p, q in zip(x, y, strict=True))
    for kind, results in ((T.StructType.fromDDL(fields), many),):
        for i, f in enumerate(kind.fields):
            column = cells._column([None if r is None else r[i] for r in results], f.dataType).to_pylist()
            assert [v is None for v in column] == [r is None for r in results]


def test_stacked_iterations_equal_single_matrices():
    rng = np.random.default_rng(8)
    spd = np.stack([b @ b.T + np.diag([9.0, 5, 2, 1]) for b in rng.normal(size=(5, 4, 4)) / 3])
    (q, t), ok = stacks.schur(spd)
    assert ok.sum() >= 3
    for m, x, y, good in zip(spd, q, t, ok, strict=True):
        if good:
            want = kernels.schur(m)
            assert np.allclose(x, want[0], atol=1e-8) and np.allclose(y, want[1], atol=1e-8)
        else:
            with pytest.raises(errors.ConvergenceFailed):
                kernels.schur(m)
    turn = np.array([[[0.0, -1.0], [1.0, 0.0]], [[1.0, 2.0], [2.0, 4.0]]])
    assert not stacks.schur(turn)[1][0]
    a, b, c = rng.normal(size=(3, 6, 4, 4)) + 4 * np.eye(4)
    b[5] = -a[5]
    (x,), ok = stacks.sylvester(a, b, c)
    assert ok.tolist() == [True] * 5 + [False]
    for i in range(5):
        assert np.allclose(x[i], kernels.sylvester(a[i], b[i], c[i])) and np.allclose(a[i] @ x[i] + x[i] @ b[i], c[i])


def test_derivatives_and_optimisation(spark):
    points = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    f = lambda x: x[0] * x[0] * x[1]
    g = {r["j"]: r["derivative"] for r in differentiation.numerical_gradient(points, f).collect()}
    assert abs(g[0] - 4) < 1e-4 and abs(g[1] - 1) < 1e-4
    h = {(r["j"], r["k"]): r["derivative"] for r in differentiation.numerical_hessian(points, f, config=differentiation.DifferenceConfig(1e-4)).collect()}
    assert np.allclose([h[0, 0], h[0, 1], h[1, 0], h[1, 1]], [4, 2, 2, 0], atol=1e-3)
    with pytest.raises(errors.InvalidInput):
        differentiation.DifferenceConfig(step_size=0)
    objective, gradient = (lambda x: float(((x - 3) ** 2).sum())), (lambda x: 2 * (x - 3))
    assert np.allclose(optimization.gradient_descent([0.0, 9], objective, gradient, optimization.DescentConfig(0.1)), 3)
    assert np.allclose(optimization.adam([0.0, 9], objective, gradient, optimization.AdamConfig(tolerance=1e-6)), 3, atol=1e-4)
    assert optimization.backtracking_line_search([0.0], [6.0], objective, gradient) == 0.5
    with pytest.raises(errors.NumericalInstability):
        optimization.backtracking_line_search([0.0], [6.0], lambda x: float(x[0]) if x[0] == 0 else float("nan"), gradient)
    with pytest.raises(errors.NumericalInstability):
        optimization.gradient_descent([0.0], objective, lambda x: np.array([1.0, 2.0]))
    with pytest.raises(errors.InvalidInput):
        optimization.LineSearchConfig(contraction=1.0)


def test_derivatives_halfway_between_two_results(spark, tmp_path):
    """Rounded by their value, as the SQL does, and not by the error of the differences."""
    known = [(118, 98.5), (178, 5426.5), (470, -988.25), (103, 5312.5), (1695, 607.5)]
    spark.createDataFrame(known, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r["c_custkey"], r["j"]): (r["d0"], r["d1"]) for r in catalogue.QUERIES["numerical_jacobian_forward"](spark, str(tmp_path)).collect()}
    assert got[118, 1] == (0.0, 0.0099) and got[178, 1] == (0.0, 0.5427) and got[470, 0] == (-0.1977, 0.1429)
    got = {(r["c_custkey"], r["j"], r["k"]): r["derivative"] for r in catalogue.QUERIES["numerical_hessian"](spark, str(tmp_path)).collect()}
    assert all(got[103, i, i] == 3.188 and got[1695, i, i] == 0.365 for i in (0, 1))


def test_reports(spark, tmp_path, monkeypatch):
    for name, group, value, ns in (("a", "svd_own_ndarray", "square-3x4", 100.0), ("b", "weird", "vector-64x1", 7.0), ("c", "qr_competitor_faer_direct", None, 8.0)):
        d = tmp_path / name / "new"
        d.mkdir(parents=True)
        (d / "benchmark.json").write_text(json.dumps({"group_id": group, "function_id": "f", "full_id": name, "value_str": value}))
        (d / "estimates.json").write_text(json.dumps({k: {"point_estimate": ns} for k in ("mean", "median", "std_dev")}))
    (tmp_path / "d/new").mkdir(parents=True)
    (tmp_path / "d/new/benchmark.json").write_text(json.dumps({"group_id": "x", "full_id": "x"}))
    entries = reporting.classify(reporting.scan(spark, str(tmp_path)), reporting.own_groups("own"))
    got = [(r["domain"], r["backend"], r["competitor"], r["shape"], r["rows"], r["cols"], r["size"]) for r in entries.collect()]
    assert got == [("svd", "ndarray", "none", "square", 3, 4, 3), ("unknown", "unknown", "unknown", "vector", 64, 1, 1), ("qr", "faer_direct", "faer_direct", "unknown", 0, 0, 0)]
    lines = reporting.summary_csv(entries).collect()
    assert tuple(lines[0].asDict()) == reporting.CSV and lines[0]["time_ns"] == "100.000" and lines[0]["throughput"] == ""
    # a row for each status: both limits must be passed, and a baseline below the floor is not compared
    now = spark.createDataFrame([("fail", 1.2e6, "none"), ("warn", 1.06e6, "none"), ("near", 107.0, "none"), ("slow", 1.02e6, "none"), ("floor", 9e9, "none"), ("new", 1.0, "none"), ("rival", 9e9, "other"), ("zero", 5.0, "none")], "full_id string, median_ns double, competitor string")
    base = spark.createDataFrame([("fail", 1e6), ("warn", 1e6), ("near", 100.0), ("slow", 1e6), ("floor", 1.0), ("rival", 1.0)], "full_id string, median_ns double")
    found = reporting.compare(now, base, reporting.Policy(min_baseline_ns=50))
    assert {r["full_id"]: r["status"] for r in found.collect()} == {"fail": "FAIL", "warn": "WARN", "near": "OK", "slow": "OK", "floor": "SKIP_NOISE_FLOOR"}
    assert tuple(reporting.regression_counts(found).head()) == (1, 1, 4)
    zero = reporting.compare(now, spark.createDataFrame([("zero", 0.0)], "full_id string, median_ns double")).head()
    assert (zero["status"], zero["delta_percent"]) == ("OK", 0.0)
    assert reporting.exit_code(found) == 3 and reporting.exit_code(None) == 2 and reporting.exit_code(found.filter("status = 'OK'")) == 0
    for name, value in (("WARN_PCT", "7.5"), ("FAIL_PCT", "x"), ("MIN_REGRESSION_NS", "-1"), ("MIN_BASELINE_NS", "inf")):
        monkeypatch.setenv(f"BENCH_{name}", value)
    assert reporting.Policy.from_environment() == reporting.Policy(warn_pct=7.5)
    history = reporting.run_record(now, "r1", 10).unionByName(reporting.run_record(now.withColumn("median_ns", F.col("median_ns") * 2), "r2", 20))
    again = reporting.upsert(history, reporting.run_record(now.withColumn("median_ns", F.col("median_ns") * 3), "r1", 30, "main", "f" * 20), 2)
    shown = reporting.run_trend(again).collect()
    assert [(r["run_id"], r["case_count"], r["git_sha"]) for r in shown] == [("r2", 7, "unknown"), ("r1", 7, "f" * 12)]
    assert shown[0]["vs_previous"] is None and np.isclose(shown[1]["vs_previous"], 50) and np.isclose(shown[1]["vs_first"], 50)
    snap = {r["benchmark"]: r for r in reporting.case_snapshot(again).collect()}
    assert np.isclose(snap["near"]["latest_ns"], 321) and np.isclose(snap["near"]["previous_ns"], 214) and snap["near"]["most_ns"] == snap["near"]["latest_ns"]
    assert [r[0] for r in reporting.upsert(again, reporting.run_record(now, "r9", 99), 1).select("run_id").collect()] == ["r9"]
    assert "| near | 107.000 | none |" in reporting.markdown(now) and reporting.markdown(spark.range(2500).toDF("n")).count("\n") == 2501
    assert reporting.capability_counts(reporting.capabilities(spark)).head()["native_provider_domains"] > 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", "a", float(h + k)) for h in range(4) for k in range(3)], "t string, kind string, value double").withColumn("t", F.to_timestamp("t"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = moments.windowed_moments(stream, "t", "value", ["kind"]).writeStream.format("memory").queryName("moments").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    want = moments.windowed_moments(events, "t", "value", ["kind"])
    assert sorted(map(tuple, spark.table("moments").collect())) == sorted(map(tuple, want.collect()))


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60
