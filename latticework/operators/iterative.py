"""Krylov solvers: vectors are tables (i, x) in the cluster, and the driver sees a few numbers a step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import kernels
from ..errors import ConvergenceFailed, DimensionMismatch, EmptyInput, NotPositiveDefinite, NumericalInstability
from ..storage import discard, materialize
from .sparse import combine

#: rows of a vector that are kept in one row of a table
BLOCK = 1024


@dataclass(frozen=True)
class IterativeConfig:
    tolerance: float = 1e-10
    max_iterations: int = 1000


def _prepared(coo: DataFrame, rhs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The matrix (i, j, v) without repeats, and the right side (i, b), both stored."""
    if not n:
        raise EmptyInput
    b = materialize(rhs.select("i", F.col("b").cast("double")), "rhs")
    if b.count() != n:
        raise DimensionMismatch
    return materialize(combine(coo), "system"), b


def _times(entries: DataFrame, vector: DataFrame, name: str) -> DataFrame:
    """(i, y): the matrix times the column ``name`` of ``vector``, where a row has entries."""
    other = vector.select(F.col("i").alias("j"), name)
    return entries.join(other, "j").groupBy("i").agg(F.sum(F.col("v") * F.col(name)).alias("y"))


def conjugate_gradient(coo: DataFrame, rhs: DataFrame, n: int, config: IterativeConfig = IterativeConfig()) -> DataFrame:
    """(i, x) for a symmetric positive definite matrix (i, j, v) and rhs (i, b); stops at an absolute residual norm."""
    entries, b = _prepared(coo, rhs, n)
    limit = max(config.tolerance, kernels.TOLERANCE)
    first = materialize(b.select("i", F.lit(0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("p")), "krylov", clean=False)
    state, stored = first, [first]
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).head()[0]
    for _ in range(config.max_iterations + 1):
        if np.sqrt(rr) <= limit:
            return state.select("i", "x")
        # two jobs a step: the sums are observed while the vectors are written
        seen, left = Observation(), Observation()
        step = state.join(_times(entries, state, "p"), "i", "left").select("i", "x", "r", "p", F.coalesce("y", F.lit(0.0)).alias("ap"))
        step = materialize(step.observe(seen, F.sum(F.col("p") * F.col("ap")).alias("curve"), F.sum(F.col("p") * F.col("p")).alias("size")), "krylov", clean=False)
        curve, size = seen.get["curve"], seen.get["size"]
        if curve <= kernels.TOLERANCE * size:  # relative: near the solution p itself is small
            raise NotPositiveDefinite
        a = F.lit(rr / curve)
        moved = step.select("i", (F.col("x") + a * F.col("p")).alias("x"), (F.col("r") - a * F.col("ap")).alias("r"), "p")
        moved = materialize(moved.observe(left, F.sum(F.col("r") * F.col("r")).alias("rr")), "krylov", clean=False)
        rr, old = left.get["rr"], rr
        discard(step, *stored)
        stored = [moved]
        state = moved.withColumn("p", F.col("r") + F.lit(rr / old) * F.col("p"))
    raise ConvergenceFailed


def _vector_blocks(table: DataFrame, name: str) -> DataFrame:
    """(block, ids, ``name``) of (i, ``name``): ``BLOCK`` neighbouring rows in one, in order."""
    dealt = table.select(F.expr(f"i div {BLOCK}").alias("block"), F.struct("i", F.coalesce(name, F.lit(0.0)).alias("x")).alias("e"))
    packed = dealt.groupBy("block").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return packed.select("block", F.col("e.i").alias("ids"), F.col("e.x").alias(name))


def _mapped(solve: Callable[..., dict], columns: list[str]):
    """``solve`` of the named columns of each row, arrays as numpy arrays; it returns the row's arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cells = [batch.column(c)[i] for c in columns]
                out = solve(*(c.values.to_numpy(zero_copy_only=False) if isinstance(c, pa.ListScalar) and c.is_valid else c.as_py() for c in cells))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out.values()], list(out))

    return run


def _summed(state: DataFrame, solve: Callable[..., dict], columns: list[str]) -> np.ndarray:
    """The sums over all blocks of the array ``s`` that ``solve`` makes of each."""
    parts = state.select(*columns).mapInArrow(_mapped(solve, columns), "s array<double>")
    found = parts.select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).collect()  # a number a vector
    return np.array([r["s"] for r in sorted(found)], float)


def gmres(coo: DataFrame, rhs: DataFrame, n: int, config: IterativeConfig = IterativeConfig()) -> DataFrame:
    """(i, x) for any matrix, without restart: a row of the state holds ``BLOCK`` rows of all of the basis, a small least-squares problem is on the driver.

    New vectors are made orthogonal in two passes; the state is dealt once a step, and a pass is a scan of it.
    """
    entries, b = _prepared(coo, rhs, n)
    limit = max(config.tolerance, kernels.TOLERANCE)
    norm = float(np.sqrt(b.agg(F.sum(F.col("b") * F.col("b"))).head()[0]))
    if norm <= limit:
        return b.select("i", F.lit(0.0).alias("x"))
    m = min(n, config.max_iterations)
    fresh = materialize(_vector_blocks(b, "b").withColumnRenamed("b", "q"), "basis", clean=False)
    h, r, g, turns = np.zeros((m + 1, m)), np.zeros((m + 1, m)), np.zeros(m + 1), []
    g[0], scale, state = norm, 1 / norm, None
    for j in range(m):
        # one more vector in the basis, and its product with the matrix
        vector = fresh.select(F.explode(F.arrays_zip("ids", "q")).alias("e")).select(F.col("e.ids").alias("j"), (F.col("e.q") * F.lit(scale)).alias("q"))
        y = entries.join(vector, "j").select(F.expr(f"i div {BLOCK}").alias("block"), "i", (F.col("v") * F.col("q")).alias("y")).repartition("block")
        y = y.groupBy("block", "i").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("y")).groupBy("block").agg(F.collect_list("i").alias("at"), F.collect_list("y").alias("y"))
        wide = fresh.join(y, "block", "left")
        wide = wide.join(state.select("block", "basis"), "block") if state is not None else wide.withColumn("basis", F.array().cast("array<double>"))

        def grown(block, ids, q, at, y, basis, scale=scale):
            w = np.zeros(len(ids))
            if at is not None:
                place = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
                known = ids[place] == at
                w[place[known]] = y[known]
            basis = np.concatenate((basis, q * scale))
            return {"block": block, "ids": ids, "basis": basis, "w": w, "s": basis.reshape(-1, len(ids)) @ w}

        columns = ["block", "ids", "q", "at", "y", "basis"]
        wide = wide.select(*columns).mapInArrow(_mapped(grown, columns), "block long, ids array<long>, basis array<double>, w array<double>, s array<double>")
        seen = Observation()
        wide = wide.observe(seen, *(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(j + 1))).drop("s")
        old, state = (fresh, state), materialize(wide, "krylov", clean=False)
        discard(*(t for t in old if t is not None))

        first = np.array([seen.get[f"s{k}"] for k in range(j + 1)])

        def left(w, basis, shares):
            q = basis.reshape(-1, len(w))
            for s in shares:
                w = w - s @ q
            return w, q

        def products(w, basis, first=first, left=left):
            w, q = left(w, basis, [first])
            return {"s": q @ w}

        shares = [first, _summed(state, products, ["w", "basis"])]
        h[: j + 1, j] = shares[0] + shares[1]

        def orthogonal(block, ids, w, basis, shares=shares, left=left):
            w, _ = left(w, basis, shares)
            return {"block": block, "ids": ids, "q": w, "ww": float(w @ w)}

        columns, seen = ["block", "ids", "w", "basis"], Observation()
        rest = state.select(*columns).mapInArrow(_mapped(orthogonal, columns), "block long, ids array<long>, q array<double>, ww double")
        fresh = materialize(rest.observe(seen, F.sum("ww").alias("ww")).drop("ww"), "basis", clean=False)
        h[j + 1, j] = float(np.sqrt(seen.get["ww"]))
        if not np.isfinite(h[: j + 2, j]).all():
            raise NumericalInstability
        # the least residual as a product of sines: it falls on where that of a solution would stay at the rounding of the norm
        r[: j + 2, j] = h[: j + 2, j]
        for k, (c, s) in enumerate(turns):
            r[k, j], r[k + 1, j] = c * r[k, j] + s * r[k + 1, j], c * r[k + 1, j] - s * r[k, j]
        size = float(np.hypot(r[j, j], r[j + 1, j]))
        c, s = (r[j, j] / size, r[j + 1, j] / size) if size else (1.0, 0.0)
        turns.append((c, s))
        r[j, j], r[j + 1, j] = size, 0.0
        g[j], g[j + 1] = c * g[j], -s * g[j]
        if h[j + 1, j] <= kernels.TOLERANCE or abs(g[j + 1]) <= 0.1 * limit:
            break
        scale = 1 / h[j + 1, j]
    k = j + 1
    if np.linalg.matrix_rank(h[:k, :k]) < k:
        raise ConvergenceFailed("breakdown")
    y = np.linalg.solve(r[:k, :k], g[:k])
    columns = ["ids", "basis"]
    x = state.select(*columns).mapInArrow(_mapped(lambda ids, basis: {"ids": ids, "x": y @ basis.reshape(-1, len(ids))}, columns), "ids array<long>, x array<double>")
    x = materialize(x.select(F.explode(F.arrays_zip("ids", "x")).alias("e")).select(F.col("e.ids").alias("i"), "e.x"), "x")
    left = b.join(_times(entries, x, "x"), "i", "left").select((F.col("b") - F.coalesce("y", F.lit(0.0))).alias("r"))
    if np.sqrt(left.agg(F.sum(F.col("r") * F.col("r"))).head()[0]) > limit:
        raise ConvergenceFailed
    discard(fresh, state)
    return x
