"""Sparse matrices as rows (i, j, v), and solvers for them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import ConvergenceFailed, DimensionMismatch, EmptyInput, InvalidInput, NumericalInstability, SingularMatrix
from ..kernels import TOLERANCE
from ..storage import discard, materialize

#: entries of a system that a driver keeps between the sweeps of a sequential solver; larger ones are read again
KEPT = 1_000_000


def validate(coo: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """``coo`` itself, if its dimensions are positive and its indices in range."""
    if nrows <= 0 or ncols <= 0:
        raise InvalidInput("invalid sparse structure")
    inside = F.col("i").between(0, nrows - 1) & F.col("j").between(0, ncols - 1) & F.col("v").isNotNull()
    if not coo.filter(~F.coalesce(inside, F.lit(False))).isEmpty():
        raise InvalidInput("invalid sparse structure")
    return coo


def from_csr(pointers: DataFrame, entries: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """(i, j, v) of compressed rows, if they are sound: pointers (i, pointer) for i from 0 to nrows, entries (k, j, v) by place k.

    The first pointer is 0, the last the number of entries, none is smaller than the one before; places run
    from 0 without gaps, columns are in range. Pointers are compared over blocks of rows, so no task holds all.
    """
    if nrows <= 0 or ncols <= 0:
        raise EmptyInput
    head = pointers.agg(F.count("*").alias("n"), F.count_distinct("i").alias("different"), F.min("i").alias("low"), F.max("i").alias("high"), F.max(F.when(F.col("i") == 0, F.col("pointer"))).alias("first"), F.max(F.when(F.col("i") == nrows, F.col("pointer"))).alias("last")).head()
    size = entries.agg(F.count("*").alias("n"), F.count_distinct("k").alias("different"), F.min("k").alias("low"), F.max("k").alias("high"), F.count_if(~F.coalesce(F.col("j").between(0, ncols - 1) & F.col("v").isNotNull(), F.lit(False))).alias("bad")).head()
    whole = (head["n"], head["different"], head["low"], head["high"], head["first"], head["last"]) == (nrows + 1, nrows + 1, 0, nrows, 0, size["n"])
    dense = size["different"] == size["n"] and (not size["n"] or (size["low"], size["high"]) == (0, size["n"] - 1))
    if not whole or not dense or size["bad"]:
        raise InvalidInput("invalid sparse structure")
    ends = pointers.select((F.col("i") - 1).alias("i"), F.col("pointer").alias("end"))
    spans = pointers.join(ends, "i")
    if not spans.filter("end < pointer").isEmpty():
        raise InvalidInput("invalid sparse structure")
    return spans.select("i", F.explode(F.when(F.col("end") > F.col("pointer"), F.sequence("pointer", F.col("end") - 1))).alias("k")).join(entries, "k").select("i", "j", "v")


def combine(coo: DataFrame) -> DataFrame:
    """Duplicates summed; explicit zeros stay."""
    return coo.groupBy("i", "j").agg(F.sum("v").alias("v"))


def to_csr(coo: DataFrame) -> DataFrame:
    """(i, cols, vals): a row's columns in order, duplicates summed; rows without entries are absent."""
    entries = combine(coo).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
    return entries.select("i", F.col("e.j").alias("cols"), F.col("e.v").alias("vals"))


def row_pointers(coo: DataFrame, nrows: int) -> DataFrame:
    """(i, begin, end) of the compressed rows, for all rows: counts are summed over blocks of rows first."""
    from pyspark.sql import Window

    counts = coo.sparkSession.range(nrows).withColumnRenamed("id", "i").join(combine(coo).groupBy("i").agg(F.count("*").alias("n")), "i", "left").fillna(0, ["n"])
    counts = counts.withColumn("block", F.expr("i div 65536"))
    before = counts.groupBy("block").agg(F.sum("n").alias("n"))
    before = before.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("base"))  # a row for 65536 rows
    inner = F.sum("n").over(Window.partitionBy("block").orderBy("i"))
    return counts.withColumn("end", inner).join(before, "block").select("i", (F.col("base") + F.col("end") - F.col("n")).alias("begin"), (F.col("base") + F.col("end")).alias("end"))


def matvec(coo: DataFrame, x: DataFrame, nrows: int) -> DataFrame:
    """(i, y) for x given as (j, x); rows without entries give 0."""
    y = coo.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    return coo.sparkSession.range(nrows).withColumnRenamed("id", "i").join(y, "i", "left").fillna(0.0, ["y"])


def jacobi_solve(coo: DataFrame, rhs: DataFrame, n: int, *, tolerance: float = 1e-10, max_iterations: int = 1000) -> DataFrame:
    """(i, x) with A x = b for rhs (i, b), from x = 0, until no entry changes by more than the tolerance.

    Every step is a join and a sum in the cluster and one job: the largest change is observed while the
    iterate is written. Only the last iterate stays.
    """
    if rhs.count() != n:
        raise DimensionMismatch
    limit = max(tolerance, TOLERANCE)
    entries = materialize(combine(coo), "system")
    d = entries.filter("i = j").select("i", F.col("v").alias("d"))
    if d.filter(F.abs("d") > TOLERANCE).count() != n:
        raise SingularMatrix("diagonal")
    off = materialize(entries.filter("i <> j"), "system")
    state = materialize(rhs.join(d, "i").select("i", F.col("b").cast("double"), "d", F.lit(0.0).alias("x")), "x", clean=False)
    for _ in range(max_iterations):
        pull = off.join(state.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("pull"))
        new = (F.col("b") - F.coalesce("pull", F.lit(0.0))) / F.col("d")
        seen = Observation()
        step = state.join(pull, "i", "left").select("i", "b", "d", new.alias("x"), F.abs(new - F.col("x")).alias("change"))
        last, state = state, materialize(step.observe(seen, F.max("change").alias("change")).select("i", "b", "d", "x"), "x", clean=False)
        discard(last)
        # NaN is larger than every number
        change = seen.get["change"]
        if change is None or not np.isfinite(change):
            raise NumericalInstability
        if change <= limit:
            return state.select("i", "x")
    raise ConvergenceFailed


def gauss_seidel_solve(coo: DataFrame, rhs: DataFrame, n: int, *, tolerance: float = 1e-10, max_iterations: int = 1000, kept: int = KEPT) -> DataFrame:
    """(i, x), each row using the rows before it.

    The sweep is sequential by definition: rows come to the driver in order, a partition at a time, and x,
    a number a row, is there. A system of at most ``kept`` entries is fetched once, a larger one in each sweep.
    """
    if rhs.count() != n:
        raise DimensionMismatch
    entries = materialize(combine(coo), "system")
    d = entries.filter("i = j").select("i", F.col("v").alias("d"))
    if d.filter(F.abs("d") > TOLERANCE).count() != n:
        raise SingularMatrix("diagonal")
    rows = entries.filter("i <> j").groupBy("i").agg(F.collect_list("j").alias("js"), F.collect_list("v").alias("vs"))
    rows = materialize(rhs.join(d, "i").join(rows, "i", "left").orderBy("i"), "rows").orderBy("i")

    def fetched():
        for r in rows.toLocalIterator(prefetchPartitions=True):
            yield r["i"], r["b"], r["d"], np.array(r["js"] or [], int), np.array(r["vs"] or [], float)

    known = list(fetched()) if entries.count() <= kept else None
    x, limit = np.zeros(n), max(tolerance, TOLERANCE)
    for _ in range(max_iterations):
        step = 0.0
        for i, b, diagonal, j, v in known if known is not None else fetched():
            new = (b - v @ x[j]) / diagonal
            step, x[i] = max(step, abs(new - x[i])), new
        if not np.isfinite(x).all():
            raise NumericalInstability
        if step <= limit:
            return coo.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    raise ConvergenceFailed
