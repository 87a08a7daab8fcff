"""The registered queries of the numerical operators and their DuckDB SQL. All run over whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import vectors as fv
from .operators import cells, differentiation, iterative, optimization, pairwise, sparse, stats, tall
from .plans import reporting
from .sources.tables import coo, table, vectors
from .streaming import moments

FLAGSHIP = "pca_line_items"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str, digits: int = 6):
    return (F.round(c, digits) + 0.0).alias(name)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors(table(spark, d, "embeddings"), "vec_id", "embedding")


# Vectors ----------------------------------------------------------------------------------------

_NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _next(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return rows.select("row_id", F.col("v").alias("a")).join(rows.select((F.col("row_id") - 1).alias("row_id"), F.col("v").alias("b")), "row_id")


@query(f"SELECT a.vec_id AS row_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0 AS dot {_NEXT}")
def vec_dot(spark, d):
    return _next(spark, d).select("row_id", r6(fv.dot("a", "b"), "dot"))


@query("SELECT vec_id AS row_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vec_norm(spark, d):
    return _vectors(spark, d).select("row_id", r6(fv.l2_norm("v"), "norm"))


@query(f"SELECT a.vec_id AS row_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0 AS similarity, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0 AS distance {_NEXT}")
def cosine(spark, d):
    return _next(spark, d).select("row_id", r6(fv.cosine_similarity("a", "b"), "similarity"), r6(fv.cosine_distance("a", "b"), "distance"))


@query("SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b")
def pairwise_l2(spark, d):
    rows = _vectors(spark, d)
    return pairwise.pairwise_l2_distance(rows, rows).withColumn("distance", F.round("distance", 6))


@query("SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0 AS similarity FROM embeddings a, embeddings b")
def pairwise_cosine(spark, d):
    rows = _vectors(spark, d)
    return pairwise.pairwise_cosine_similarity(rows, rows).withColumn("similarity", F.round("similarity", 6) + 0.0)


@query("SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0 AS distance FROM embeddings a, embeddings b")
def pairwise_cosine_distance(spark, d):
    rows = _vectors(spark, d)
    return pairwise.pairwise_cosine_distance(rows, rows).withColumn("distance", F.round("distance", 6) + 0.0)


@query("""SELECT left_id, right_id, rank::INTEGER AS rank, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY s DESC, right_id) AS rank FROM (
    SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s
    FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 5""")
def cosine_topk(spark, d):
    rows = _vectors(spark, d)
    return pairwise.cosine_top_k(rows, rows, 5, digits=9).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT a.vec_id AS row_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0 AS dot {_NEXT}")
def batched_dot(spark, d):
    rows = _vectors(spark, d)
    return pairwise.batched_dot(rows, rows.withColumn("row_id", F.col("row_id") - 1)).withColumn("dot", F.round("dot", 6) + 0.0)


@query(f"""WITH p AS (SELECT a.vec_id, a.embedding[1:32]::DOUBLE[] AS ar, a.embedding[33:64]::DOUBLE[] AS ai, b.embedding[1:32]::DOUBLE[] AS br, b.embedding[33:64]::DOUBLE[] AS bi {_NEXT}),
s AS (SELECT vec_id, list_dot_product(ar, br) + list_dot_product(ai, bi) AS re, list_dot_product(ar, bi) - list_dot_product(ai, br) AS im,
  sqrt(list_dot_product(ar, ar) + list_dot_product(ai, ai)) AS na, sqrt(list_dot_product(br, br) + list_dot_product(bi, bi)) AS nb FROM p)
SELECT vec_id AS row_id, round(re, 6) + 0 AS re, round(im, 6) + 0 AS im, round(na, 6) AS norm, round(re / (na * nb), 6) + 0 AS cos_re, round(im / (na * nb), 6) + 0 AS cos_im FROM s""")
def complex_vectors(spark, d):
    half = lambda c: fv.complex_vector(F.slice(c, 1, 32), F.slice(c, 33, 32))
    rows = _next(spark, d).select("row_id", half("a").alias("a"), half("b").alias("b"))
    dot, cos = fv.dot_hermitian("a", "b"), fv.cosine_similarity_complex("a", "b")
    return rows.select("row_id", r6(dot["re"], "re"), r6(dot["im"], "im"), r6(fv.l2_norm_complex("a"), "norm"), r6(cos["re"], "cos_re"), r6(cos["im"], "cos_im"))


# Statistics -------------------------------------------------------------------------------------


@query("SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in NUMERIC) + " FROM lineitem")
def column_means(spark, d):
    return stats.column_means(table(spark, d, "lineitem"), NUMERIC).select(*(r6(F.col(c), c) for c in NUMERIC))


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c} - avg({c}) OVER (), 3) + 0 AS {c}" for c in NUMERIC) + " FROM lineitem")
def center_columns(spark, d):
    return stats.center_columns(table(spark, d, "lineitem"), NUMERIC).select("l_orderkey", "l_linenumber", *(r6(F.col(c), c, 3) for c in NUMERIC))


def _pairs_sql(value: str, name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS row, '{b}' AS col, round({value.format(a=a, b=b)}, 6) + 0 AS {name} FROM lineitem" for a in NUMERIC for b in NUMERIC)


@query(_pairs_sql("covar_samp({a}, {b})", "covariance"))
def covariance_matrix(spark, d):
    return stats.covariance_matrix(table(spark, d, "lineitem"), NUMERIC).withColumn("covariance", F.round("covariance", 6) + 0.0)


@query(_pairs_sql("covar_samp({a}, {b}) / greatest(sqrt(var_samp({a}) * var_samp({b})), 2.220446049250313e-16)", "correlation"))
def correlation_matrix(spark, d):
    return stats.correlation_matrix(table(spark, d, "lineitem"), NUMERIC).withColumn("correlation", F.round("correlation", 6) + 0.0)


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared FROM lineitem GROUP BY l_returnflag")
def linear_regression_grouped(spark, d):
    fit = stats.grouped_regression(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return fit.select("l_returnflag", r6(F.col("slope"), "slope", 4), r6(F.col("intercept"), "intercept", 3), r6(F.col("r_squared"), "r_squared"))


@query("""WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_tax) AS b, covar_pop(l_tax, l_tax) AS c,
  covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_tax, l_extendedprice) AS q, avg(l_quantity) AS mx, avg(l_tax) AS mt, avg(l_extendedprice) AS my, var_pop(l_extendedprice) AS v FROM lineitem),
t AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2 FROM s)
SELECT round(my - b1 * mx - b2 * mt, 3) AS intercept, round(b1, 3) AS quantity, round(b2, 3) AS tax, round((b1 * p + b2 * q) / v, 6) AS r_squared FROM t""")
def linear_regression(spark, d):
    fit = stats.linear_regression(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice")
    return spark.createDataFrame([(*(round(float(c), 3) for c in fit.coefficients), round(float(fit.r_squared), 6))], "intercept double, quantity double, tax double, r_squared double")


_PCA_SQL = """WITH s AS (SELECT avg(l_quantity) AS mq, avg(l_extendedprice / 1000) AS me, covar_samp(l_quantity, l_quantity) AS a, covar_samp(l_quantity, l_extendedprice / 1000) AS b, covar_samp(l_extendedprice / 1000, l_extendedprice / 1000) AS c FROM lineitem),
e AS (SELECT *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l1, (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l2 FROM s)"""


@query(_PCA_SQL + "SELECT 1 AS component, round(l1, 4) AS variance, round(l1 / (l1 + l2), 6) AS ratio FROM e UNION ALL SELECT 2, round(l2, 4), round(l2 / (l1 + l2), 6) FROM e")
def pca_line_items(spark, d):
    rows = _two(spark, d)
    found = stats.pca(rows)
    data = [(i + 1, round(float(v), 4), round(float(r), 6)) for i, (v, r) in enumerate(zip(found.explained_variance, found.explained_variance_ratio, strict=True))]
    return spark.createDataFrame(data, "component int, variance double, ratio double")


def _two(spark, d) -> DataFrame:
    items = table(spark, d, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return items.select(key.alias("row_id"), F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("v"))


@query(_PCA_SQL + """, w AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS x, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS y FROM e),
g AS (SELECT *, CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS s FROM w)
SELECT l_orderkey * 10 + l_linenumber AS row_id, round(s * (x * (l_quantity - mq) + y * (l_extendedprice / 1000 - me)), 4) + 0 AS score,
  round(mq + x * (x * (l_quantity - mq) + y * (l_extendedprice / 1000 - me)), 4) + 0 AS back FROM lineitem, g""")
def pca_transform(spark, d):
    rows = _two(spark, d)
    found = stats.pca(rows, 1)
    scored = rows.select("row_id", found.transform(F.col("v")).alias("scores"))
    return scored.select("row_id", r6(F.col("scores")[0], "score", 4), r6(found.inverse_transform(F.col("scores"))[0], "back", 4))


_SPECTRUM = """WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_extendedprice / 1000) AS b, sum(l_extendedprice / 1000 * l_extendedprice / 1000) AS c FROM lineitem),
e AS (SELECT *, sqrt((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2) AS s1, sqrt((a * c - b * b) / ((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2)) AS s2, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l1 FROM g),
w AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS x, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS y FROM e),
v AS (SELECT *, CASE WHEN abs(x) >= abs(y) THEN sign(x) ELSE sign(y) END AS s FROM w) """


@query(_SPECTRUM + "SELECT round(s1, 3) AS s1, round(s2, 3) AS s2, round(s * x, 6) + 0 AS v11, round(s * y, 6) + 0 AS v12 FROM v")
def svd_line_items(spark, d):
    """Both singular values and the first right vector of a tall table."""
    found = tall.svd(_two(spark, d))
    (s1, s2), (v11, v12) = found.singular_values, found.vt[0]
    return spark.createDataFrame([tuple(round(float(x), n) + 0.0 for x, n in ((s1, 3), (s2, 3), (v11, 6), (v12, 6)))], "s1 double, s2 double, v11 double, v12 double")


@query(_SPECTRUM + "SELECT l_orderkey * 10 + l_linenumber AS row_id, round(1000 * s * (x * l_quantity + y * l_extendedprice / 1000) / s1, 5) + 0 AS u1 FROM lineitem, v")
def svd_left_vectors(spark, d):
    return tall.svd(_two(spark, d), 1).u.select("row_id", r6(F.col("u")[0] * 1000, "u1", 5))


@query("WITH e AS (SELECT embedding[1:4]::DOUBLE[] AS v FROM embeddings) SELECT " + ", ".join(f"round(sum(v[{i + 1}] * v[{j + 1}]), 5) + 0 AS g{i}{j}" for i in range(4) for j in range(i, 4)) + " FROM e")
def svd_embeddings(spark, d):
    """Singular values and right vectors of four columns, put together to the table's products again."""
    found = tall.svd(vectors(table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("e")), "vec_id", "e"))
    g = (found.vt.T * found.singular_values**2) @ found.vt
    return spark.createDataFrame([tuple(round(float(g[i, j]), 5) + 0.0 for i in range(4) for j in range(i, 4))], ", ".join(f"g{i}{j} double" for i in range(4) for j in range(i, 4)))


@query()
def pca_embeddings(spark, d):
    found = stats.pca(_vectors(spark, d), 8)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(found.explained_variance_ratio)], "component int, ratio double")


@query("""WITH s AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_extendedprice / 1000) AS b, sum(l_extendedprice / 1000 * l_extendedprice / 1000) AS c FROM lineitem)
SELECT round(sqrt(a), 3) AS r11, round(b / sqrt(a), 3) AS r12, round(sqrt(c - b * b / a), 3) AS r22 FROM s""")
def tall_qr(spark, d):
    r = tall.tsqr(_two(spark, d))
    return spark.createDataFrame([tuple(round(float(x), 3) for x in (r[0, 0], r[0, 1], r[1, 1]))], "r11 double, r12 double, r22 double")


@query("SELECT round(regr_intercept(l_extendedprice / 1000, l_quantity), 5) AS intercept, round(regr_slope(l_extendedprice / 1000, l_quantity), 5) AS slope FROM lineitem")
def tall_least_squares(spark, d):
    rows = _two(spark, d).select("row_id", F.array(F.lit(1.0), F.col("v")[0]).alias("v"), F.col("v")[1].alias("y"))
    b = tall.least_squares(rows)
    return spark.createDataFrame([(round(float(b[0]), 5), round(float(b[1]), 5))], "intercept double, slope double")


# One small matrix a group -----------------------------------------------------------------------

_KEYS = ["l_returnflag", "l_linestatus"]
_S = """WITH s AS (SELECT l_returnflag, l_linestatus, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_extendedprice / 1000) AS b, var_samp(l_extendedprice / 1000) AS c FROM lineitem GROUP BY ALL),
e AS (SELECT *, a * c - b * b AS det, sqrt((a - c) * (a - c) + 4 * b * b) AS dd, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l1, (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l2 FROM s)
"""


def _groups(spark, d) -> DataFrame:
    items = table(spark, d, "lineitem").select(*_KEYS, F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    s = items.groupBy(*_KEYS).agg(F.var_samp("x").alias("a"), F.covar_samp("x", "y").alias("b"), F.var_samp("y").alias("c"))
    return s.select(*_KEYS, cells.cell([[F.col("a"), F.col("b")], [F.col("b"), F.col("c")]]).alias("m"), F.array("a", "c").alias("rhs"))


def _cell_query(name: str, operator: str, args: tuple[str, ...], outputs: dict[str, tuple[str, str]], digits: int = 5, extra: dict | None = None) -> None:
    """``outputs``: column -> (expression over result, SQL over the group's a, b, c, det, dd, l1, l2)."""

    def run(spark, d):
        groups = _groups(spark, d)
        for c, v in (extra or {}).items():
            groups = groups.withColumn(c, v())
        if args[0].startswith("result."):
            groups = cells.apply(groups, "svd_decompose" if "svd" in operator else "qr_decompose", "m")
        out = cells.apply(groups, operator, *args)
        return out.select(*_KEYS, *(r6(F.expr(e), c, digits) for c, (e, _) in outputs.items()))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = _S + "SELECT l_returnflag, l_linestatus, " + ", ".join(f"round({sql}, {digits}) + 0 AS {c}" for c, (_, sql) in outputs.items()) + " FROM e"


def _of(f: str) -> dict[str, tuple[str, str]]:
    """The entries of f(S) by its spectrum."""
    one, two = f.format("l1"), f.format("l2")
    return {
        "f11": ("result.f.values[0]", f"({one} * (a - l2) - {two} * (a - l1)) / dd"),
        "f12": ("result.f.values[1]", f"({one} - {two}) * b / dd"),
        "f22": ("result.f.values[3]", f"({one} * (c - l2) - {two} * (c - l1)) / dd"),
    }


def _named(*parts: tuple[str, str, str]) -> dict[str, tuple[str, str]]:
    return {c: (e, s) for c, e, s in parts}


_cell_query("lu_decompose", "lu_decompose", ("m",), _named(("l21", "result.l.values[2]", "CASE WHEN abs(b) > abs(a) THEN a / b ELSE b / a END"), ("u11", "result.u.values[0]", "CASE WHEN abs(b) > abs(a) THEN b ELSE a END"), ("u22", "result.u.values[3]", "CASE WHEN abs(b) > abs(a) THEN b - a / b * c ELSE c - b / a * b END")))
_cell_query("lu_solve", "lu_solve", ("m", "rhs"), _named(("x1", "result.x[0]", "(a * c - b * c) / det"), ("x2", "result.x[1]", "(a * c - a * b) / det")))
_cell_query("matrix_inverse", "inverse", ("m",), _named(("i11", "result.inverse.values[0]", "c / det"), ("i12", "result.inverse.values[1]", "-b / det"), ("i22", "result.inverse.values[3]", "a / det")))
_cell_query("determinant", "determinant", ("m",), _named(("det", "result.determinant", "det")), 4)
_cell_query("log_determinant", "log_determinant", ("m",), _named(("sign", "cast(result.sign as double)", "sign(det)::DOUBLE"), ("ln_abs_det", "result.ln_abs_det", "ln(abs(det))")))
_cell_query("cholesky_decompose", "cholesky_decompose", ("m",), _named(("l11", "result.l.values[0]", "sqrt(a)"), ("l21", "result.l.values[2]", "b / sqrt(a)"), ("l22", "result.l.values[3]", "sqrt(c - b * b / a)")))
_cell_query("cholesky_solve", "cholesky_solve", ("m", "rhs"), _named(("x1", "result.x[0]", "(a * c - b * c) / det"), ("x2", "result.x[1]", "(a * c - a * b) / det")))
_cell_query("cholesky_inverse", "cholesky_inverse", ("m",), _named(("i11", "result.inverse.values[0]", "c / det"), ("i12", "result.inverse.values[1]", "-b / det"), ("i22", "result.inverse.values[3]", "a / det")))
_cell_query("triangular_lower", "solve_lower", ("m", "rhs"), _named(("x1", "result.x[0]", "1.0"), ("x2", "result.x[1]", "(c - b) / c")))
_cell_query("triangular_upper", "solve_upper", ("m", "rhs"), _named(("x1", "result.x[0]", "(a - b) / a"), ("x2", "result.x[1]", "1.0")))
_cell_query("qr_decompose", "qr_decompose", ("m",), _named(("r11", "result.r.values[0]", "sqrt(a * a + b * b)"), ("r12", "result.r.values[1]", "(a * b + b * c) / sqrt(a * a + b * b)"), ("r22", "result.r.values[3]", "abs(det) / sqrt(a * a + b * b)"), ("q11", "result.q.values[0]", "a / sqrt(a * a + b * b)")))
_cell_query("qr_condition", "qr_condition_number", ("result.r",), _named(("condition", "result.condition", "greatest(sqrt(a * a + b * b), abs(det) / sqrt(a * a + b * b)) / least(sqrt(a * a + b * b), abs(det) / sqrt(a * a + b * b))")), 4)
_cell_query("orthogonalize", "gram_schmidt", ("m",), _named(("q11", "result.q.values[0]", "a / sqrt(a * a + b * b)"), ("q21", "result.q.values[2]", "b / sqrt(a * a + b * b)")))
_cell_query("least_squares", "least_squares", ("m", "rhs"), _named(("x1", "result.x[0]", "(a * c - b * c) / det"), ("x2", "result.x[1]", "(a * c - a * b) / det")))
_cell_query("eigen_symmetric", "eigen_symmetric", ("m",), _named(("l1", "result.values[0]", "l1"), ("l2", "result.values[1]", "l2")))
_cell_query("svd_values", "svd_decompose", ("m",), _named(("s1", "result.s[0]", "l1"), ("s2", "result.s[1]", "l2")))
_cell_query("svd_condition", "svd_condition_number", ("m",), _named(("condition", "result.condition", "l1 / l2")), 4)
_cell_query("svd_reconstruct", "svd_reconstruct", ("result.u", "result.s", "result.vt"), _named(("p11", "result.product.values[0]", "a"), ("p12", "result.product.values[1]", "b"), ("p22", "result.product.values[3]", "c")))
_cell_query("pseudo_inverse", "pseudo_inverse", ("m",), _named(("i11", "result.inverse.values[0]", "c / det"), ("i12", "result.inverse.values[1]", "-b / det"), ("i22", "result.inverse.values[3]", "a / det")))
_cell_query("schur_form", "schur", ("m",), _named(("l1", "result.t.values[0]", "l1"), ("l2", "result.t.values[3]", "l2")))
_cell_query("matrix_log_eigen", "matrix_log_eigen", ("m",), _of("ln({})"))
_cell_query("matrix_log_svd", "matrix_log_svd", ("m",), _of("ln({})"))
_cell_query("matrix_power", "matrix_power", ("m", "p"), _of("sqrt({})"), extra={"p": lambda: F.lit(0.5)})
_SMALL = {"small": lambda: F.expr("struct(2 as nrows, 2 as ncols, array(m.values[0] / 400, m.values[1] / 400, m.values[2] / 400, m.values[3] / 400) as values)")}
_cell_query("matrix_exp_taylor", "matrix_exp", ("small",), _of("exp({} / 400)"), extra=_SMALL)
_cell_query("matrix_exp_eigen", "matrix_exp_eigen", ("small",), _of("exp({} / 400)"), extra=_SMALL)
_NEAR = {"near": lambda: F.expr("struct(2 as nrows, 2 as ncols, array(1 + m.values[0] / 4000, m.values[1] / 4000, m.values[2] / 4000, 1 + m.values[3] / 4000) as values)")}
_cell_query("matrix_log_taylor", "matrix_log_taylor", ("near",), _of("ln(1 + {} / 4000)"), extra=_NEAR)


# Matrices without symmetry ----------------------------------------------------------------------

_G = """WITH g AS (SELECT l_suppkey, avg(l_quantity) * 0.99731 AS a, avg(l_discount) * 99.731 AS b, avg(l_tax) * 99.731 AS c, avg(l_extendedprice) / 1002.7 AS d FROM lineitem GROUP BY l_suppkey),
t AS (SELECT *, a * d - b * c AS det, a * a + b * b + c * c + d * d AS f, (a + d) / 2 AS h, sqrt((a - d) * (a - d) / 4 + b * c) AS q, a * a + c * c + b * b AS n11, a * b + c * d + b * a AS n12, b * b + d * d + a * a AS n22 FROM g),
s AS (SELECT *, sqrt((f + sqrt(f * f - 4 * det * det)) / 2) AS s1, abs(det) / sqrt((f + sqrt(f * f - 4 * det * det)) / 2) AS s2,
  CASE WHEN n11 > 0 THEN sqrt(n11) END AS r11 FROM t)
"""


def _general(spark, d) -> DataFrame:
    """A 2 x 2 matrix (a, b; c, d) for each supplier, none symmetric, and others made of its entries."""
    items = table(spark, d, "lineitem")
    # factors that keep averages of few rows off the middle between two rounded numbers
    g = items.groupBy("l_suppkey").agg((F.avg("l_quantity") * 0.99731).alias("a"), (F.avg("l_discount") * 99.731).alias("b"), (F.avg("l_tax") * 99.731).alias("c"), (F.avg("l_extendedprice") / 1002.7).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    z = F.lit(0.0)
    whole = lambda rows: _complex_cell(rows)
    return g.select(
        "*",
        cells.cell([[a, b], [c, d]]).alias("m"),
        cells.cell([[a, c], [b, d]]).alias("mt"),
        cells.cell([[d, b], [c, a]]).alias("m2"),
        cells.cell([[a, b], [b, d]]).alias("sym"),
        cells.cell([[a, d], [d, -a]]).alias("saddle"),
        cells.cell([[a, b], [c, d], [b, a]]).alias("tall"),
        cells.cell([[a, b], [2 * a, 2 * b]]).alias("flat"),
        cells.cell([[a / 40, b / 40], [c / 40, d / 40]]).alias("small"),
        cells.cell([[F.lit(2.0), F.lit(0.5)], [F.lit(0.5), F.lit(1.0)]]).alias("metric"),
        F.lit(20.0).alias("cut"),
        F.lit(1).alias("one"),
        whole([[(a, b), (c, z)], [(z, c), (d, a)]]).alias("z"),
        whole([[(a, b), (z, z)], [(c, z), (d, a)]]).alias("zl"),
        whole([[(a, b), (c, z)], [(z, z), (d, a)]]).alias("zu"),
        F.array(a, d, c).alias("rhs3"),
        F.array(F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), F.struct(F.lit(0.0).alias("re"), F.lit(1.0).alias("im"))).alias("unit"),
    )


def _complex_cell(rows):
    flat = [F.struct(re.cast("double").alias("re"), im.cast("double").alias("im")) for r in rows for re, im in r]
    return F.struct(F.lit(len(rows)).alias("nrows"), F.lit(len(rows[0])).alias("ncols"), F.array(*flat).alias("values"))


def _general_query(name: str, steps: list[tuple], outputs: dict[str, tuple[str, str]], digits: int = 5) -> None:
    """``steps``: (operator, arguments, options) one after another; a later one may take ``result`` of the one before."""

    def run(spark, d):
        out = _general(spark, d)
        for operator, args, options in steps:
            out = cells.apply(out, operator, *args, **options)
        return out.select("l_suppkey", *(r6(F.expr(e).cast("double"), c, digits) for c, (e, _) in outputs.items()))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = _G + "SELECT l_suppkey, " + ", ".join(f"round(({sql})::DOUBLE, {digits}) + 0 AS {c}" for c, (_, sql) in outputs.items()) + " FROM s"


def _entries_of(value: str, names: str = "abcd") -> dict[str, tuple[str, str]]:
    return {f"p{i}": (f"{value}[{i}]", n) for i, n in enumerate(names)}


def _real_entries(value: str, parts: list[str]) -> dict[str, tuple[str, str]]:
    """Of a complex matrix: re and im of each entry."""
    return {f"p{i}_{x}": (f"{value}[{i // 2}].{x}", sql) for i, (x, sql) in enumerate(zip(["re", "im"] * (len(parts) // 2), parts, strict=True))}


_Z = ["a", "b", "c", "0.0", "0.0", "c", "d", "a"]
_general_query("lu_general", [("lu_decompose", ("m",), {})], _named(("l21", "result.l.values[2]", "CASE WHEN abs(c) > abs(a) THEN a / c ELSE c / a END"), ("u11", "result.u.values[0]", "CASE WHEN abs(c) > abs(a) THEN c ELSE a END"), ("u12", "result.u.values[1]", "CASE WHEN abs(c) > abs(a) THEN d ELSE b END"), ("u22", "result.u.values[3]", "CASE WHEN abs(c) > abs(a) THEN b - a / c * d ELSE d - c / a * b END")))
_general_query("inverse_general", [("inverse", ("m",), {})], _entries_of("result.inverse.values", ["d / det", "-b / det", "-c / det", "a / det"]))
_general_query("determinant_general", [("determinant", ("m",), {})], _named(("det", "result.determinant", "det")), 4)
_general_query("svd_general", [("svd_decompose", ("m",), {})], _named(("s1", "result.s[0]", "s1"), ("s2", "result.s[1]", "s2")))
_general_query("svd_rebuilt", [("svd_decompose", ("m",), {}), ("svd_reconstruct", ("result.u", "result.s", "result.vt"), {})], _entries_of("result.product.values"))
_F2 = "(a * a + b * b + 2 * c * c + d * d + a * a)"
_DZ = "((a * d - a * b) * (a * d - a * b) + (a * a + b * d - c * c) * (a * a + b * d - c * c))"
_general_query("svd_complex", [("svd_decompose_complex", ("z",), {})], _named(("s1", "result.s[0]", f"sqrt(({_F2} + sqrt({_F2} * {_F2} - 4 * {_DZ})) / 2)"), ("product", "result.s[0] * result.s[1]", f"sqrt({_DZ})")), 4)
_general_query("svd_rebuilt_complex", [("svd_decompose_complex", ("z",), {}), ("svd_reconstruct_complex", ("result.u", "result.s", "result.vt"), {})], _real_entries("result.product.values", _Z))
_general_query("svd_tolerance", [("svd_with_tolerance", ("m", "cut"), {})], _named(("s1", "result.s[0]", "CASE WHEN s1 < 20 THEN 0 ELSE s1 END"), ("s2", "result.s[1]", "CASE WHEN s2 < 20 THEN 0 ELSE s2 END")))
_general_query("svd_truncated", [("svd_truncated", ("m", "one"), {})], _named(("s1", "result.s[0]", "s1"), ("kept", "size(result.s) + result.u.ncols + result.vt.nrows", "3.0")))
_general_query("svd_rank", [("svd_rank", ("m",), {"tolerance": 24.0})], _named(("rank", "result.rank", "(s1 > 24)::INT + (s2 > 24)::INT")))
_general_query("svd_rank_default", [("svd_rank", ("flat",), {})], _named(("rank", "result.rank + a - a", "CASE WHEN a > 0 THEN 1 ELSE 0 END")))
_general_query("pseudo_inverse_flat", [("pseudo_inverse", ("flat",), {})], _entries_of("result.inverse.values", [f"{x} / (5 * (a * a + b * b))" for x in ("a", "2 * a", "b", "2 * b")]))
_general_query("pseudo_inverse_tolerance", [("pseudo_inverse", ("m",), {"tolerance": 1000.0})], _named(("p0", "result.inverse.values[0] + a", "a")))
_general_query("null_space", [("null_space", ("flat",), {})], _named(("n1", "abs(result.basis.values[0])", "b / sqrt(a * a + b * b)"), ("n2", "abs(result.basis.values[1])", "a / sqrt(a * a + b * b)"), ("dimension", "result.basis.ncols", "1.0")))
_general_query("qr_reduced", [("qr_reduced", ("tall",), {})], _named(("r11", "result.r.values[0]", "r11"), ("r12", "result.r.values[1]", "n12 / r11"), ("r22", "result.r.values[3]", "sqrt(n22 - n12 * n12 / n11)"), ("q31", "result.q.values[4]", "b / r11"), ("rank", "result.rank", "2.0")), 4)
_general_query("qr_pivoted", [("qr_pivoted", ("tall",), {})], _named(("r11", "result.r.values[0]", "r11"), ("r12", "result.r.values[1]", "n12 / r11"), ("p11", "result.p.values[0]", "1.0")), 4)
_general_query("qr_tolerance", [("qr_decompose", ("tall",), {"tolerance": 30.0})], _named(("rank", "result.rank", "(r11 > 30)::INT + (CASE WHEN r11 > 30 THEN sqrt(n22 - n12 * n12 / n11) > 30 ELSE sqrt(n22) > 30 END)::INT")))
_general_query("qr_rebuilt", [("qr_decompose", ("tall",), {}), ("qr_reconstruct", ("result.q", "result.r"), {})], _entries_of("result.product.values", "abcdba"))
_general_query("qr_complex", [("qr_decompose_complex", ("z",), {})], _named(("r11", "result.r.values[0].re", "sqrt(a * a + b * b + c * c)"), ("volume", "result.r.values[0].re * result.r.values[3].re", f"sqrt({_DZ})")), 4)
_general_query("qr_rebuilt_complex", [("qr_decompose_complex", ("z",), {}), ("qr_reconstruct_complex", ("result.q", "result.r"), {})], _real_entries("result.product.values", _Z))
_general_query("least_squares_tall", [("least_squares", ("tall", "rhs3"), {})], _named(("x1", "result.x[0]", "(n22 * (a * a + c * d + b * c) - n12 * (a * b + d * d + a * c)) / (n11 * n22 - n12 * n12)"), ("x2", "result.x[1]", "(n11 * (a * b + d * d + a * c) - n12 * (a * a + c * d + b * c)) / (n11 * n22 - n12 * n12)")))
_general_query("schur_general", [("schur", ("m",), {})], _named(("l1", "result.t.values[0]", "h + q"), ("l2", "result.t.values[3]", "h - q"), ("corner", "abs(result.t.values[1])", "abs(b - c)")), 4)
_PQ = "sqrt(f + 2 * abs(det))"
_general_query("polar_form", [("polar", ("m",), {})], _named(("p11", "result.p.values[0]", f"(a * a + c * c + abs(det)) / {_PQ}"), ("p12", "result.p.values[1]", f"(a * b + c * d) / {_PQ}"), ("p22", "result.p.values[3]", f"(b * b + d * d + abs(det)) / {_PQ}"), ("u11", "result.u.values[0]", f"(a + sign(det) * d) / {_PQ}"), ("u12", "result.u.values[1]", f"(b - sign(det) * c) / {_PQ}")))
_general_query("polar_complex", [("polar_complex", ("z",), {})], _named(("trace", "result.p.values[0].re + result.p.values[3].re", f"sqrt({_F2} + 2 * sqrt({_DZ}))"), ("norm", "sqrt(aggregate(result.u.values, 0D, (s, x) -> s + x.re * x.re + x.im * x.im))", "sqrt(2.0)")), 4)
_BACK = "{}.values[{}] * result.x.values[{}] + {}.values[{}] * result.x.values[{}]"
_general_query("sylvester", [("sylvester", ("m", "m2", "mt"), {})], {f"r{i}{j}": (f"m.values[{2 * i}] * result.x.values[{j}] + m.values[{2 * i + 1}] * result.x.values[{2 + j}] + result.x.values[{2 * i}] * m2.values[{j}] + result.x.values[{2 * i + 1}] * m2.values[{2 + j}]", "acbd"[2 * i + j]) for i in (0, 1) for j in (0, 1)})
_general_query("lyapunov", [("lyapunov", ("m", "sym"), {})], {f"r{i}{j}": (f"m.values[{2 * i}] * result.x.values[{j}] + m.values[{2 * i + 1}] * result.x.values[{2 + j}] + result.x.values[{2 * i}] * m.values[{2 * j}] + result.x.values[{2 * i + 1}] * m.values[{2 * j + 1}]", "-" + "abbd"[2 * i + j]) for i in (0, 1) for j in (0, 1)})
_X1 = ("a / (a * a + b * b)", "-b / (a * a + b * b)")
_general_query("triangular_lower_complex", [("solve_lower_complex", ("zl", "unit"), {})], _named(("x1_re", "result.x[0].re", _X1[0]), ("x1_im", "result.x[0].im", _X1[1]), ("x2_re", "result.x[1].re", f"((-c * {_X1[0]}) * d + (1 - c * {_X1[1]}) * a) / (a * a + d * d)"), ("x2_im", "result.x[1].im", f"((1 - c * {_X1[1]}) * d + c * {_X1[0]} * a) / (a * a + d * d)")))
_X2 = ("a / (a * a + d * d)", "d / (a * a + d * d)")
_general_query("triangular_upper_complex", [("solve_upper_complex", ("zu", "unit"), {})], _named(("x2_re", "result.x[1].re", _X2[0]), ("x2_im", "result.x[1].im", _X2[1]), ("x1_re", "result.x[0].re", f"((1 - c * {_X2[0]}) * a - c * {_X2[1]} * b) / (a * a + b * b)"), ("x1_im", "result.x[0].im", f"(-c * {_X2[1]} * a - (1 - c * {_X2[0]}) * b) / (a * a + b * b)")))
_C11, _C22, _C12 = "(a - 0.5 * b) / 1.75", "(2 * d - 0.5 * b) / 1.75", "((b - 0.5 * d) + (2 * b - 0.5 * a)) / 3.5"
_GAP = f"sqrt(({_C11} - {_C22}) * ({_C11} - {_C22}) + 4 * ({_C12}) * ({_C12}))"
_general_query("eigen_generalized", [("eigen_generalized", ("sym", "metric"), {})], _named(("l1", "result.values[0]", f"({_C11} + {_C22} + {_GAP}) / 2"), ("l2", "result.values[1]", f"({_C11} + {_C22} - {_GAP}) / 2")))
_PEN = "sqrt((a + 2 * d - b) * (a + 2 * d - b) - 7 * (a * d - b * b))"
_general_query("eigen_generalized_spd", [("eigen_generalized_spd", ("sym", "metric"), {})], _named(("l1", "result.values[0]", f"(a + 2 * d - b + {_PEN}) / 3.5"), ("l2", "result.values[1]", f"(a + 2 * d - b - {_PEN}) / 3.5")))
_general_query("matrix_sign", [("matrix_sign", ("saddle",), {})], _named(("f11", "result.f.values[0]", "a / sqrt(a * a + d * d)"), ("f12", "result.f.values[1]", "d / sqrt(a * a + d * d)"), ("f22", "result.f.values[3]", "-a / sqrt(a * a + d * d)")))
_general_query("matrix_exp_general", [("matrix_exp", ("small",), {"terms": 64, "tolerance": 1e-14})], {f"f{i}": (f"result.f.values[{i}]", f"exp(h / 40) * ({'cosh(q / 40) + ' if i in (0, 3) else ''}sinh(q / 40) / q * ({n}{' - h' if i in (0, 3) else ''}))") for i, n in enumerate("abcd")})


@query("WITH s AS (SELECT s_suppkey, unnest(range(6)) AS j FROM supplier) SELECT s_suppkey, j, round((s_suppkey + j) % 5 + 1.0, 5) AS lu, round((s_suppkey + j) % 5 + 1.0, 5) AS qr, round((s_suppkey + j) % 5 + 1.0, 5) AS inverse FROM s")
def solve_wide(spark, d):
    """6 x 6 systems with known solutions, by LU, by least squares on a taller matrix and by the inverse."""
    n, m = 6, 9
    entry = lambda i, j: ((F.col("s_suppkey") * 7 + i * 13 + j * 29) % 17) / 17.0 + (6.0 if i == j else 0.0)
    x = [(F.col("s_suppkey") + j) % 5 + 1.0 for j in range(n)]
    right = lambda rows: F.array(*(sum((entry(i, j) * x[j] for j in range(n)), F.lit(0.0)) for i in range(rows)))
    rows = table(spark, d, "supplier").select("s_suppkey", cells.cell([[entry(i, j) for j in range(n)] for i in range(n)]).alias("m"), cells.cell([[entry(i, j) for j in range(n)] for i in range(m)]).alias("t"), right(n).alias("b"), right(m).alias("c"))
    out = cells.apply(rows, "lu_solve", "m", "b", into="lu")
    out = cells.apply(out, "least_squares", "t", "c", into="qr")
    out = cells.apply(out, "inverse", "m", into="inv")
    back = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.zip_with(F.slice("inv.inverse.values", i * n + 1, n), F.col("b"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))
    flat = out.select("s_suppkey", F.posexplode(F.arrays_zip(F.col("lu.x").alias("lu"), F.col("qr.x").alias("qr"), back.alias("inverse"))).alias("j", "x"))
    return flat.select("s_suppkey", F.col("j").cast("long").alias("j"), *(r6(F.col(f"x.{c}"), c, 5) for c in ("lu", "qr", "inverse")))


# Sparse systems ---------------------------------------------------------------------------------


def _entries(spark, d) -> DataFrame:
    return coo(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")


@query("SELECT l_suppkey AS i, count(*) AS entries, round(sum(v), 4) AS total, min(l_partkey) AS first_col FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def coo_to_csr(spark, d):
    csr = sparse.to_csr(_entries(spark, d))
    return csr.select("i", F.size("cols").cast("long").alias("entries"), r6(F.aggregate("vals", F.lit(0.0), lambda s, x: s + x), "total", 4), F.col("cols")[0].alias("first_col"))


@query("SELECT r.i, round(coalesce(sum(l_quantity * p_retailprice), 0), 2) AS y FROM (SELECT unnest(range((SELECT max(s_suppkey) + 1 FROM supplier))) AS i) r LEFT JOIN (lineitem JOIN part ON p_partkey = l_partkey) ON l_suppkey = r.i GROUP BY r.i")
def csr_matvec(spark, d):
    n = table(spark, d, "supplier").agg(F.max("s_suppkey")).head()[0] + 1
    x = table(spark, d, "part").select(F.col("p_partkey").alias("j"), F.col("p_retailprice").cast("double").alias("x"))
    return sparse.matvec(_entries(spark, d), x, n).select("i", r6(F.col("y"), "y", 2))


@query("SELECT l_suppkey AS i, l_partkey AS j, round(sum(l_quantity), 4) AS v FROM lineitem GROUP BY ALL")
def csr_roundtrip(spark, d):
    """To compressed rows and, checked, back."""
    n = table(spark, d, "supplier").agg(F.max("s_suppkey")).head()[0] + 1
    m = table(spark, d, "part").agg(F.max("p_partkey")).head()[0] + 1
    csr, pointers = sparse.to_csr(_entries(spark, d)), sparse.row_pointers(_entries(spark, d), n)
    ends = pointers.select("i", F.col("begin").alias("pointer")).unionByName(pointers.filter(F.col("i") == n - 1).select((F.col("i") + 1).alias("i"), F.col("end").alias("pointer")))
    places = csr.join(pointers, "i").select("begin", F.posexplode(F.arrays_zip("cols", "vals")).alias("at", "e")).select((F.col("begin") + F.col("at")).alias("k"), F.col("e.cols").alias("j"), F.col("e.vals").alias("v"))
    return sparse.from_csr(ends, places, n, m).select("i", "j", r6(F.col("v"), "v", 4))


_TRUTH = "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, round(s_nationkey + s_acctbal / 1000, 5) + 0 AS x FROM supplier"


def _system(spark, d):
    """A tridiagonal system over the suppliers with a known solution; rows are numbered by their keys' order."""
    from pyspark.sql import Window

    rows = table(spark, d, "supplier").select((F.row_number().over(Window.orderBy("s_suppkey")) - 1).cast("long").alias("i"), (F.col("s_nationkey") + F.col("s_acctbal") / 1000).alias("x"))
    n = rows.count()
    a = rows.select("i", F.explode(F.array(*(F.struct((F.col("i") + k).alias("j"), F.lit(v).alias("v")) for k, v in ((-1, -1.0), (0, 4.0), (1, -1.0))))).alias("e")).select("i", "e.j", "e.v").filter(f"j between 0 and {n - 1}")
    b = a.join(rows.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("b"))
    return a, b, n


def _solver_query(name: str, solve):
    def run(spark, d):
        return solve(*_system(spark, d)).select("i", r6(F.col("x"), "x", 5))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, _TRUTH


_solver_query("jacobi_solve", sparse.jacobi_solve)
_solver_query("gauss_seidel_solve", sparse.gauss_seidel_solve)
_solver_query("conjugate_gradient", iterative.conjugate_gradient)
_solver_query("gmres", iterative.gmres)


# Optimisation and derivatives -------------------------------------------------------------------


def _fit(spark, d):
    rows = table(spark, d, "lineitem").select(F.array(F.lit(1.0), F.col("l_quantity") / 50, F.col("l_extendedprice") / 100_000).alias("v"))
    return optimization.squared_error(rows)


_FIT = "SELECT round(regr_intercept(l_extendedprice / 100000, l_quantity / 50), 4) AS intercept, round(regr_slope(l_extendedprice / 100000, l_quantity / 50), 4) AS slope FROM lineitem"


@query(_FIT)
def gradient_descent(spark, d):
    x = optimization.gradient_descent(np.zeros(2), *_fit(spark, d), optimization.DescentConfig(learning_rate=0.3))
    return spark.createDataFrame([(round(float(x[0]), 4), round(float(x[1]), 4))], "intercept double, slope double")


@query(_FIT)
def adam(spark, d):
    x = optimization.adam(np.zeros(2), *_fit(spark, d), optimization.AdamConfig(tolerance=1e-7))
    return spark.createDataFrame([(round(float(x[0]), 4), round(float(x[1]), 4))], "intercept double, slope double")


@query("WITH c AS (SELECT s_suppkey, s_suppkey % 9 + 1 AS k FROM supplier WHERE s_suppkey <= 30) SELECT s_suppkey, pow(0.5, (SELECT min(j) FROM range(20) t(j) WHERE pow(0.5, j) * k <= 2 - 2e-4)) AS step FROM c")
def line_search(spark, d):
    """On 2 x^2 along -k x: the first step s of 1, 1/2, ... with s k <= 2 - 2e-4."""
    rows = table(spark, d, "supplier").filter("s_suppkey <= 30").select("s_suppkey", F.greatest(F.abs("s_acctbal"), F.lit(1.0)).alias("x")).orderBy("s_suppkey").collect()  # 30 starting points
    step = lambda x, k: optimization.backtracking_line_search([x], [-k * x], lambda p: 2 * float(p @ p), lambda p: 4 * p)
    return spark.createDataFrame([(r[0], step(r[1], r[0] % 9 + 1)) for r in rows], "s_suppkey long, step double")


def _points(spark, d) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.array(F.col("c_acctbal") / 10_000, F.col("c_custkey") % 7 / 7.0).alias("x"))


def _f(x):
    return x[0] * x[0] + 3 * x[0] * x[1] + 2 * x[1] * x[1]


def _settled(c, name: str, digits: int, held: int = 6):
    """``c`` rounded to the ``held`` digits that its differences hold, then to ``digits`` by the SQL's rule.

    A derivative halfway between two results, such as 0.00985, would else be rounded by the differences' error.
    """
    return (F.round(F.round(c, held) * 10.0**digits) / 10.0**digits + 0.0).alias(name)


_X = "(SELECT c_custkey, c_acctbal / 10000 AS x, c_custkey % 7 / 7.0 AS y FROM customer)"


@query(f"SELECT c_custkey, 0 AS j, round(2 * x + 3 * y, 3) + 0 AS derivative FROM {_X} UNION ALL SELECT c_custkey, 1, round(3 * x + 4 * y, 3) + 0 FROM {_X}")
def numerical_gradient(spark, d):
    return differentiation.numerical_gradient(_points(spark, d), _f, config=differentiation.DifferenceConfig(step_size=1e-8)).select("c_custkey", "j", r6(F.col("derivative"), "derivative", 3))


@query(f"SELECT c_custkey, 0 AS j, round(2 * x, 5) + 0 AS d0, 1.0 AS d1 FROM {_X} UNION ALL SELECT c_custkey, 1, 1.0, round(2 * y, 5) + 0 FROM {_X}")
def numerical_jacobian(spark, d):
    """Of (x^2 + y, x + y^2), by central differences, exact but for rounding."""
    f = lambda x: F.array(x[0] * x[0] + x[1], x[0] + x[1] * x[1])
    out = differentiation.numerical_jacobian_central(_points(spark, d), f)
    return out.select("c_custkey", "j", r6(F.col("derivative")[0], "d0", 5), r6(F.col("derivative")[1], "d1", 5))


@query(f"SELECT c_custkey, 0 AS j, round(2 * x, 4) + 0 AS d0, round(y, 4) + 0 AS d1 FROM {_X} UNION ALL SELECT c_custkey, 1, 0.0, round(x, 4) + 0 FROM {_X}")
def numerical_jacobian_forward(spark, d):
    """Of (x^2, x y), by forward differences."""
    f = lambda x: F.array(x[0] * x[0], x[0] * x[1])
    out = differentiation.numerical_jacobian(_points(spark, d), f, config=differentiation.DifferenceConfig(step_size=1e-7))
    return out.select("c_custkey", "j", _settled(F.col("derivative")[0], "d0", 4), _settled(F.col("derivative")[1], "d1", 4))


@query(f"SELECT c_custkey, j, k, round(CASE WHEN j + k = 0 THEN 6 * x WHEN j + k = 1 THEN 6 * y ELSE 6 * x END, 3) + 0 AS derivative FROM {_X}, (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS k)")
def numerical_hessian(spark, d):
    """Of x^3 + 3 x y^2, whose second derivatives are 6 x, 6 y and 6 x."""
    f = lambda x: x[0] * x[0] * x[0] + 3 * x[0] * x[1] * x[1]
    out = differentiation.numerical_hessian(_points(spark, d), f, config=differentiation.DifferenceConfig(step_size=1e-4))
    return out.select("c_custkey", "j", "k", _settled(F.col("derivative"), "derivative", 3))


# Reports and streams ----------------------------------------------------------------------------


@query("""WITH m AS (SELECT l_shipdate, l_returnflag AS benchmark, date_trunc('month', l_shipdate) AS "at", l_extendedprice FROM lineitem),
g AS (SELECT benchmark, "at", median(l_extendedprice) AS median_ns FROM m GROUP BY ALL)
SELECT benchmark, "at", round(median_ns, 4) AS median_ns,
  round((median_ns - lag(median_ns) OVER w) / lag(median_ns) OVER w * 100, 4) + 0 AS vs_previous,
  round((median_ns - first_value(median_ns) OVER w) / first_value(median_ns) OVER w * 100, 4) + 0 AS vs_first,
  round(min(median_ns) OVER (PARTITION BY benchmark), 4) AS least_ns, round(max(median_ns) OVER (PARTITION BY benchmark), 4) AS most_ns
FROM g WINDOW w AS (PARTITION BY benchmark ORDER BY "at")""")
def report_trends(spark, d):
    items = table(spark, d, "lineitem")
    medians = items.groupBy(F.col("l_returnflag").alias("benchmark"), F.date_trunc("month", "l_shipdate").alias("at")).agg(F.median("l_extendedprice").alias("median_ns"))
    return reporting.trends(medians).select("benchmark", "at", *(r6(F.col(c), c, 4) for c in ("median_ns", "vs_previous", "vs_first", "least_ns", "most_ns")))


_SIDES = "SELECT l_suppkey, 100 * median(l_extendedprice) FILTER (l_shipdate < TIMESTAMP '1995-06-17') AS b, 100 * median(l_extendedprice) FILTER (l_shipdate >= TIMESTAMP '1995-06-17') AS c FROM lineitem GROUP BY l_suppkey"


@query(f"""WITH m AS ({_SIDES}), x AS (SELECT 'supplier/' || l_suppkey AS full_id, c AS now, b AS before, c - b AS gap, (c - b) / b * 100 AS delta FROM m WHERE b IS NOT NULL AND c IS NOT NULL)
SELECT full_id, round(now, 4) AS current_ns, round(before, 4) AS baseline_ns, CASE WHEN before >= 3300000 THEN round(delta, 4) + 0 END AS delta_percent,
  CASE WHEN before < 3300000 THEN 'SKIP_NOISE_FLOOR' WHEN gap > 25000 AND delta > 2 THEN 'FAIL' WHEN gap > 25000 AND delta > 1 THEN 'WARN' ELSE 'OK' END AS status FROM x""")
def report_compare(spark, d):
    items = table(spark, d, "lineitem").withColumn("full_id", F.concat(F.lit("supplier/"), F.col("l_suppkey")))
    early = F.col("l_shipdate") < F.to_timestamp(F.lit("1995-06-17 00:00:00"))
    medians = lambda rows: rows.groupBy("full_id").agg((100 * F.median("l_extendedprice")).alias("median_ns"))
    policy = reporting.Policy(warn_pct=1, fail_pct=2, min_baseline_ns=3_300_000)
    out = reporting.compare(medians(items.filter(~early)).withColumn("competitor", F.lit("none")), medians(items.filter(early)), policy)
    return out.select("full_id", r6(F.col("current_ns"), "current_ns", 4), r6(F.col("baseline_ns"), "baseline_ns", 4), r6(F.col("delta_percent"), "delta_percent", 4), "status")


_GROUPS = ("svd_own_ndarray", "qr_own_ndarray", "matrix_functions_own_ndarray", "sparse_competitor_ndarray", "svd_competitor_faer_direct", "qr_competitor_ndarray_linalg", "optimization_competitor_manual", "vector_other", "weird")
_VALUES = ("square-{}x{}", "vector-{}x1", "tall-{}x{}x2", "odd-{}by{}", "none", "bad-ax{}", "a-b-{}x{}", "-{}x{}")


def _named_case(column: str, cases: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cases.items()) + f" ELSE '{other}' END"


@query(f"""WITH p AS (SELECT p_partkey, {list(_GROUPS)}[p_partkey % {len(_GROUPS)} + 1] AS group_id, replace({list(_VALUES)}[p_partkey % {len(_VALUES)} + 1], '{{}}', p_size::VARCHAR) AS v FROM part),
x AS (SELECT *, CASE WHEN contains(v, '-') THEN substr(v, 1, instr(v, '-') - 1) ELSE 'unknown' END AS shape, CASE WHEN contains(v, '-') THEN substr(v, instr(v, '-') + 1) ELSE '' END AS dims FROM p),
n AS (SELECT *, CASE WHEN contains(dims, 'x') THEN coalesce(TRY_CAST(nullif(regexp_extract(substr(dims, 1, instr(dims, 'x') - 1), '^[0-9]+$'), '') AS BIGINT), 0) ELSE 0 END AS rows,
  CASE WHEN contains(dims, 'x') THEN coalesce(TRY_CAST(nullif(regexp_extract(substr(dims, instr(dims, 'x') + 1), '^[0-9]+$'), '') AS BIGINT), 0) ELSE 0 END AS cols FROM x)
SELECT p_partkey, CASE WHEN starts_with(group_id, 'matrix_functions_') THEN 'matrix_functions' WHEN group_id = 'weird' THEN 'unknown' ELSE split_part(group_id, '_', 1) END AS domain,
  {_named_case("group_id", {"svd_own_ndarray": "ndarray", "qr_own_ndarray": "ndarray", "matrix_functions_own_ndarray": "ndarray", "sparse_competitor_ndarray": "ndarray_baseline", "svd_competitor_faer_direct": "faer_direct", "qr_competitor_ndarray_linalg": "ndarray_linalg", "optimization_competitor_manual": "manual_baseline"}, "unknown")} AS backend,
  {_named_case("group_id", {"svd_own_ndarray": "none", "qr_own_ndarray": "none", "matrix_functions_own_ndarray": "none", "sparse_competitor_ndarray": "ndarray_baseline", "svd_competitor_faer_direct": "faer_direct", "qr_competitor_ndarray_linalg": "ndarray_linalg", "optimization_competitor_manual": "manual_baseline"}, "unknown")} AS competitor,
  shape, rows, cols, least(rows, cols) AS size FROM n""")
def report_classify(spark, d):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    entries = table(spark, d, "part").select("p_partkey", pick(_GROUPS).alias("group_id"), F.lit("f").alias("function_id"), F.col("p_partkey").cast("string").alias("full_id"), F.replace(pick(_VALUES), F.lit("{}"), F.col("p_size").cast("string")).alias("value_str"))
    return reporting.classify(entries, reporting.own_groups("own")).select("p_partkey", "domain", "backend", "competitor", "shape", "rows", "cols", "size")


def _runs(spark, d) -> DataFrame:
    """A run for each month, of three benchmarks."""
    items = table(spark, d, "lineitem").withColumn("at", F.date_trunc("month", "l_shipdate"))
    cases = items.groupBy("at", F.col("l_returnflag").alias("full_id")).agg(F.median("l_extendedprice").alias("median_ns"))
    runs = cases.groupBy("at").agg(F.count("*").alias("case_count"), reporting.geometric_mean(F.col("median_ns")).alias("geometric_mean_ns"), F.map_from_entries(F.collect_list(F.struct("full_id", "median_ns"))).alias("medians"))
    return runs.select(F.date_format("at", "yyyy-MM").alias("run_id"), F.lit("local").alias("branch"), F.lit("0123456789abcdef").alias("git_sha"), F.unix_timestamp("at").alias("generated_at_unix"), "case_count", "geometric_mean_ns", "medians")


def _history(spark, d) -> DataFrame:
    """All months, a run more of the orders, and the latest 20 of these."""
    orders = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("full_id")).agg(F.median("o_totalprice").alias("median_ns"))
    return reporting.upsert(_runs(spark, d), reporting.run_record(orders.withColumn("competitor", F.lit("none")), "orders", 4_000_000_000))


_HISTORY = """WITH m AS (SELECT date_trunc('month', l_shipdate) AS "at", l_returnflag AS f, median(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
r AS (SELECT strftime("at", '%Y-%m') AS run_id, epoch("at")::BIGINT AS t, f, v FROM m UNION ALL SELECT 'orders', 4000000000, o_orderstatus, median(o_totalprice) FROM orders GROUP BY o_orderstatus),
k AS (SELECT run_id, t FROM r GROUP BY ALL ORDER BY t DESC LIMIT 20), h AS (SELECT r.* FROM r JOIN k USING (run_id)),
g AS (SELECT run_id, t, count(*) AS case_count, exp(avg(ln(v))) AS mean FROM h GROUP BY ALL)"""


@query(_HISTORY + """ SELECT run_id, '0123456789ab'[:CASE WHEN run_id = 'orders' THEN 0 ELSE 12 END] || CASE WHEN run_id = 'orders' THEN 'unknown' ELSE '' END AS git_sha, t AS generated_at_unix, case_count, round(mean, 4) AS geometric_mean_ns,
  round((mean - lag(mean) OVER w) / lag(mean) OVER w * 100, 4) + 0 AS vs_previous, round((mean - first_value(mean) OVER w) / first_value(mean) OVER w * 100, 4) + 0 AS vs_first FROM g WINDOW w AS (ORDER BY t)""")
def report_history(spark, d):
    out = reporting.run_trend(_history(spark, d))
    return out.select("run_id", "git_sha", "generated_at_unix", "case_count", *(r6(F.col(c), c, 4) for c in ("geometric_mean_ns", "vs_previous", "vs_first")))


@query(_HISTORY + """, o AS (SELECT *, dense_rank() OVER (ORDER BY t DESC) AS age FROM h WHERE run_id <> 'orders')
SELECT f AS benchmark, round(max(v) FILTER (age = 1), 4) AS latest_ns, round(max(v) FILTER (age = 2), 4) AS previous_ns, round((max(v) FILTER (age = 1) - max(v) FILTER (age = 2)) / max(v) FILTER (age = 2) * 100, 4) + 0 AS vs_previous,
  round(min(v), 4) AS least_ns, round(max(v), 4) AS most_ns FROM o GROUP BY f HAVING max(v) FILTER (age = 1) IS NOT NULL""")
def report_snapshot(spark, d):
    out = reporting.case_snapshot(_history(spark, d).filter("run_id <> 'orders'"))
    return out.select("benchmark", *(r6(F.col(c), c, 4) for c in ("latest_ns", "previous_ns", "vs_previous", "least_ns", "most_ns")))


@query()
def report_capabilities(spark, d):
    return reporting.capabilities(spark)


@query("SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS geometric_mean FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_returnflag")
def report_geometric_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(reporting.geometric_mean(F.col("l_extendedprice")), "geometric_mean", 4))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance FROM events GROUP BY ALL")
def windowed_moments(spark, d):
    out = moments.windowed_moments(table(spark, d, "events"), "ts", "value", ["event_type"])
    return out.select("window_start", "event_type", "n", r6(F.col("mean"), "mean"), r6(F.col("variance"), "variance"))


@query("SELECT l_orderkey, l_linenumber, (rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber))::INTEGER AS rank FROM lineitem QUALIFY rank <= 3")
def keep_latest(spark, d):
    """The report's keep-last-N, a group at a time."""
    order = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.rank().over(order).alias("rank")).filter("rank <= 3")
