"""Search of a stated query set against all rows, in bounded blocks.

Rows with equal keys are gathered into one point that carries its ``k + 1`` smallest ids (no more can
be among k answers), points are dealt evenly over shards of a bounded size, every query goes to every
shard in blocks of a bounded size, and each block's answers are merged to the best k a query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: queries in one block
QUERY_BLOCK = 65_536


def deal(rows: DataFrame, key: str, k: int, shard_rows: int) -> DataFrame:
    """(shard, ids, key): a row for each different key of ``rows`` (vec_id, key), in shards of about ``shard_rows``."""
    near = Window.partitionBy(key).orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(near)).filter(F.col("nth") <= k + 1)
    points = materialize(few.groupBy(key).agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    shards = max(1, -(-points.count() // shard_rows))
    return points.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), "ids", key)


def matrix_of(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    """The rows of a column of lists, which must be of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    sizes = np.diff(column.offsets.to_numpy())
    if n and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    return flat.astype(kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def gathered(queries: list[int], found, score: Callable, ids: pa.ChunkedArray | pa.Array, k: int) -> tuple[list, list, list]:
    """Query ids, vec ids and scores of the best ``k`` answers of each query, its own row left out.

    ``found``: the points found for each query; ``score(i, points)``: their exact scores, best largest.
    """
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
    out: tuple[list, list, list] = ([], [], [])
    for i, (own, row) in enumerate(zip(queries, found, strict=True)):
        row = row[row >= 0]
        size = ends[row + 1] - ends[row]
        who = flat[np.repeat(ends[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        value = np.repeat(score(i, row), size)
        value, who = value[who != own], who[who != own]
        best = np.lexsort((who, -value))[:k]
        out[0].extend([own] * len(best))
        out[1].extend(who[best].tolist())
        out[2].extend(value[best].tolist())
    return out


def best_of(found: DataFrame, k: int, score: str, best_first: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` of each query, ties to the smaller vec_id."""
    order = [F.desc(score) if best_first else F.asc(score), F.asc("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)


def search(rows: DataFrame, key: str, is_query: str, k: int, shard_rows: int, solve: Callable, score: str, best_first: bool) -> DataFrame:
    """(query_id, rank, vec_id, score column) for each row of ``rows`` (vec_id, key column) that satisfies ``is_query``.

    ``solve(points, queries)`` gets two Arrow tables (ids and key; query and key) and returns lists of
    query ids, vec ids and scores; a query's own row is not among its answers.
    """
    dealt = deal(rows, key, k, shard_rows)
    shards = (dealt.agg(F.max("shard")).head()[0] or 0) + 1
    queries = rows.filter(is_query).select("vec_id", key)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    # a point goes to its shard once for each block of queries
    left = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("long").alias("query"), "ids", key)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block, F.col("vec_id").alias("query"), F.lit(None).cast("array<bigint>").alias("ids"), key)

    def run(table: pa.Table) -> pa.Table:
        is_point = table.column("query").is_null()
        q, v, s = solve(table.filter(is_point), table.filter(table.column("query").is_valid()))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), score: pa.array(s, pa.float64())})

    found = left.unionByName(right).groupBy("shard", "block").applyInArrow(run, f"query_id long, vec_id long, {score} double")
    return best_of(found, k, score, best_first)


def sound_vectors(rows: DataFrame, column: str) -> DataFrame:
    """(vec_id, column) without null ids and without null, empty, zero, or partly null or non-finite vectors."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(column, lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).filter(~F.coalesce(bad, F.lit(False)) & F.coalesce(some, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), column)
