"""Exact top-k by Hamming distance: incremental multi-index hashing of binary codes.

A code of 64 bits is cut into ``SEGMENTS`` parts, each with an index from its value to the codes. For
r = 0, 1, ... a query looks up all values within r bits of its own in every index and verifies what is
new. After radius r every code within ``SEGMENTS * (r + 1) - 1`` bits has been seen, so a query is done
when its k-th verified distance is no more than that.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import search, sound_vectors

K_NEAREST, SHARD, SEGMENTS, EVERY = 10, 65_536, 4, 100


def sign_codes(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, code): bit i of the code is set where component i of a vector is positive.

    A vector of more than 64 components is an error: its code would not fit.
    """
    wide = F.raise_error(F.lit("a code holds 64 components"))
    rows = rows.withColumn(column, F.when(F.size(column) > 64, wide.cast(rows.schema[column].dataType)).otherwise(F.col(column)))
    bit = F.transform(column, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    code = F.aggregate(bit, F.lit(0).cast("long"), lambda s, e: s.bitwiseOR(F.when(e["x"] > 0, F.call_function("shiftleft", F.lit(1).cast("long"), e["i"])).otherwise(F.lit(0).cast("long"))))
    return rows.select("vec_id", code.alias("code"))


class MultiIndex:
    def __init__(self, codes: np.ndarray, segments: int = SEGMENTS):
        self.codes, self.segments, self.width = codes, segments, 64 // segments
        low = np.uint64((1 << self.width) - 1)
        self.parts = [(codes >> np.uint64(s * self.width)) & low for s in range(segments)]
        self.order = [np.argsort(p, kind="stable") for p in self.parts]
        self.first = [np.searchsorted(p[o], np.arange((1 << self.width) + 1, dtype=np.uint64)) for p, o in zip(self.parts, self.order, strict=True)]

    def masks(self, radius: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for c in combinations(range(self.width), radius)], np.uint64)

    def within(self, query: np.uint64, masks: np.ndarray) -> np.ndarray:
        """Codes that have a segment at just this radius from the query's."""
        out = []
        for s in range(self.segments):
            own = (query >> np.uint64(s * self.width)) & np.uint64((1 << self.width) - 1)
            values = (own ^ masks).astype(np.int64)
            a, b = self.first[s][values], self.first[s][values + 1]
            size = b - a
            out.append(self.order[s][np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())])
        return np.unique(np.concatenate(out))


def distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def _solve(k: int):
    def solve(points: pa.Table, queries: pa.Table):
        if not points.num_rows or not queries.num_rows:
            return [], [], []
        ids = points.column("ids").to_pylist()
        index = MultiIndex(points.column("code").to_numpy().view(np.uint64))
        masks = [index.masks(r) for r in range(index.width + 1)]
        out_q, out_v, out_s = [], [], []
        for query, own in zip(queries.column("code").to_numpy().view(np.uint64), queries.column("query").to_pylist(), strict=True):
            seen = np.zeros(len(ids), bool)
            found: list[tuple[int, int]] = []
            for r in range(index.width + 1):
                new = index.within(query, masks[r])
                new = new[~seen[new]]
                seen[new] = True
                far = distance(index.codes[new], query)
                found += [(d, v) for d, i in zip(far.tolist(), new.tolist(), strict=True) for v in ids[i] if v != own]
                found = sorted(found)[:k]
                if len(found) == k and found[-1][0] <= index.segments * (r + 1) - 1:
                    break
            out_q += [own] * len(found)
            out_v += [v for _, v in found]
            out_s += [float(d) for d, _ in found]
        return out_q, out_v, out_s

    return solve


def top_k(codes: DataFrame, is_query: str, *, k: int = K_NEAREST, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, distance): for each query the ``k`` other rows nearest by Hamming distance, exactly.

    ``codes``: vec_id, code (64 bits as a long). Ties go to the smaller vec_id. A null id or code takes no
    part; a repeated row counts once. Equal codes are one point of the index and all answer. An empty
    table gives an empty result.
    """
    rows = codes.filter("vec_id is not null and code is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "code").distinct()
    out = search(rows, "code", is_query, k, shard, _solve(k), "distance", False)
    return out.withColumn("distance", F.col("distance").cast("long"))


def op4_hamming_topk(spark, sf_dir: str) -> DataFrame:
    rows = sound_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")
    return top_k(sign_codes(rows), f"vec_id % {EVERY} = 0")


QUERIES = {"op4_hamming_topk": op4_hamming_topk}
ORACLES = {
    "op4_hamming_topk": """
WITH c AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END).array_to_string('')::BIT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::BIGINT AS distance FROM c AS q JOIN c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10
"""
}
