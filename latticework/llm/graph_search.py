"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard.

Vectors get one more component that makes their lengths equal, so that the largest inner product is the
smallest distance. A shard's graph grows by batches of points: a greedy search from the medoid of the
first ones finds the neighbours of each new point, robust pruning (drop a candidate that a kept neighbour
is closer to by the factor ``alpha``) keeps few, diverse edges, and edges back are pruned where a point has
too many. The graphs are a table, built once. Queries run a beam search in every shard, in blocks; scores
of what it finds are computed again in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import QUERY_BLOCK, best_of, deal, gathered, matrix_of, sound_vectors
from .storage import materialize

K_NEAREST, SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA, EVERY = 20, 1 << 17, 48, 64, 160, 1.2, 20
#: points expanded at once in a search; flags (queries by points) held at once; points inserted at once
EXPAND, FLAGS, BATCH, FIRST = 4, 1 << 26, 2048, 256


def _distances(points: np.ndarray, square: np.ndarray, a: np.ndarray, queries: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of points ``a`` to the queries ``q``, without the queries' own squares."""
    return square[a] - 2 * np.einsum("ij,ij->i", points[a], queries[q])


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, int]:
    """The ``beam`` nearest points found for each query, nearest first (-1: none), and the number of distances computed."""
    square = np.einsum("ij,ij->i", points, points)
    block = max(1, min(512, FLAGS // len(points)))
    out, total = [], 0
    for at in range(0, len(queries), block):
        found, cost = _search(points, square, graph, start, queries[at : at + block], beam)
        out.append(found)
        total += cost
    return np.concatenate(out) if out else np.zeros((0, beam), np.int64), total


def _search(points: np.ndarray, square: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, int]:
    m = len(queries)
    ids = np.full((m, beam), -1, np.int32)
    far = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, len(points)), bool)
    ids[:, 0], done[:, 0] = start, False
    far[:, 0] = _distances(points, square, np.full(m, start), queries, np.arange(m))
    seen[:, start] = True
    rows, cost = np.arange(m), m
    while len(rows):
        wait = np.where(done[rows], np.inf, far[rows])
        pick = np.argpartition(wait, EXPAND - 1, 1)[:, :EXPAND] if beam > EXPAND else np.argsort(wait, 1)
        open_ = np.isfinite(np.take_along_axis(wait, pick, 1))
        at = np.where(open_, ids[rows[:, None], pick], -1)
        done[rows[:, None], pick] = True
        near = np.where(at[:, :, None] >= 0, graph[at], -1).reshape(len(rows), -1)
        near.sort(1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        new &= ~seen[rows[:, None], near]
        r, c = np.nonzero(new)
        who = near[r, c]
        seen[rows[r], who] = True
        gap = np.full(near.shape, np.inf, np.float32)
        gap[r, c] = _distances(points, square, who, queries, rows[r])
        cost += len(r)
        all_far = np.concatenate((far[rows], gap), 1)
        order = np.argpartition(all_far, beam - 1, 1)[:, :beam]
        far[rows] = np.take_along_axis(all_far, order, 1)
        ids[rows] = np.take_along_axis(np.concatenate((ids[rows], np.where(new, near, -1)), 1), order, 1)
        done[rows] = np.take_along_axis(np.concatenate((done[rows], ~new), 1), order, 1)
        rows = rows[~done[rows].all(1)]
    order = far.argsort(1, kind="stable")
    return np.where(np.isfinite(np.take_along_axis(far, order, 1)), np.take_along_axis(ids, order, 1), -1), cost


def robust_prune(points: np.ndarray, who: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point of ``who`` from its row of ``cand`` (-1: none)."""
    out = np.full((len(who), degree), -1, np.int32)
    for at in range(0, len(who), 256):
        own, place = who[at : at + 256], np.sort(cand[at : at + 256], 1)
        place[place == own[:, None]] = -1
        place[:, 1:][place[:, 1:] == place[:, :-1]] = -1
        vec = points[place]
        far = np.where(place >= 0, ((vec - points[own][:, None]) ** 2).sum(2), np.inf)
        square = np.einsum("ijk,ijk->ij", vec, vec)
        gap = (square[:, :, None] + square[:, None, :] - 2 * vec @ vec.transpose(0, 2, 1)) * np.float32(alpha * alpha)
        rows = np.arange(len(own))
        for j in range(degree):
            best = far.argmin(1)
            ok = np.isfinite(far[rows, best])
            if not ok.any():
                break
            out[at : at + 256][ok, j] = place[rows, best][ok]
            far[gap[rows, best] <= far] = np.inf
            far[rows, best] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1) -> tuple[np.ndarray, int]:
    """Neighbours of each point (-1: none) and the point at which searches start."""
    n = len(points)
    width = degree + degree // 2
    graph = np.full((n, width), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    first = order[:FIRST]
    start = int(first[((points[first] - points.mean(0)) ** 2).sum(1).argmin()])
    at = 0
    while at < n:
        who = order[at : at + (FIRST if not at else min(at, BATCH))]
        if not at:  # the first ones from all of each other
            found = np.broadcast_to(who, (len(who), len(who)))
        else:
            found = beam_search(points, graph, start, points[who], beam)[0]
        graph[who, :degree] = robust_prune(points, who, found, degree, alpha)
        _back(points, graph, who, degree, alpha)
        at += len(who)
    return graph, start


def _back(points: np.ndarray, graph: np.ndarray, who: np.ndarray, degree: int, alpha: float) -> None:
    """The other direction of the new edges of ``who``; a point with no room for them is pruned."""
    width = graph.shape[1]
    a, b = np.repeat(who, degree), graph[who, :degree].reshape(-1)
    a, b = a[b >= 0], b[b >= 0]
    by = np.argsort(b, kind="stable")
    a, b = a[by], b[by]
    ends, begin, count = np.unique(b, return_index=True, return_counts=True)
    nth = np.arange(len(b)) - np.repeat(begin, count)
    have = (graph[ends] >= 0).sum(1)
    room = have + count <= width
    easy = np.repeat(room, count)
    graph[b[easy], (np.repeat(have, count) + nth)[easy]] = a[easy]
    full = np.flatnonzero(~room)
    # the few with very many new edges by themselves, so that the others' candidates stay narrow
    for part in (full[count[full] <= width], full[count[full] > width]):
        if len(part):
            extra = np.full((len(ends), int(count[part].max())), -1, np.int32)
            chosen = np.isin(np.repeat(np.arange(len(ends)), count), part)
            extra[np.repeat(np.arange(len(ends)), count)[chosen], nth[chosen]] = a[chosen]
            e = ends[part]
            step = max(1, (1 << 22) // (width + extra.shape[1]) ** 2)
            for at in range(0, len(e), step):
                some = e[at : at + step]
                pruned = robust_prune(points, some, np.concatenate((graph[some], extra[part[at : at + step]]), 1), degree, alpha)
                graph[some, :degree], graph[some, degree:] = pruned, -1


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One component more, by which all have the length of the longest."""
    square = np.einsum("ij,ij->i", vectors, vectors)
    return np.concatenate((vectors, np.sqrt(np.maximum(0, square.max(initial=0) - square))[:, None]), 1).astype(np.float32)


def _built(degree: int, beam: int, column: str):
    def run(rows: pa.Table) -> pa.Table:
        graph, start = build(lifted(matrix_of(rows.column(column))), degree, beam)
        near = pa.FixedSizeListArray.from_arrays(pa.array(graph.reshape(-1)), graph.shape[1]).cast(pa.list_(pa.int32()))
        place = np.arange(len(graph))
        return pa.table({"shard": rows.column("shard"), "place": pa.array(place), "start": pa.array(place == start), "ids": rows.column("ids"), column: rows.column(column), "near": near})

    return run


def _asked(k: int, beam: int, column: str):
    def run(rows: pa.Table) -> pa.Table:
        is_point = rows.column("query").is_null()
        points = rows.filter(is_point).sort_by("place")
        asked = rows.filter(rows.column("query").is_valid())
        out = ([], [], [])
        if points.num_rows and asked.num_rows:
            exact, queries = matrix_of(points.column(column)), matrix_of(asked.column(column))
            graph = matrix_of(points.column("near"), np.int32)
            start = int(np.flatnonzero(points.column("start").to_numpy())[0])
            flat = np.concatenate((queries, np.zeros((len(queries), 1))), 1).astype(np.float32)
            found, _ = beam_search(lifted(exact), graph, start, flat, max(beam, k + 1))
            out = gathered(asked.column("query").to_pylist(), found, lambda i, row: (exact[row] * queries[i]).sum(1), points.column("ids"), k)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def graphs(rows: DataFrame, *, k: int = K_NEAREST, column: str = "embedding", shard: int = SHARD, degree: int = DEGREE, beam: int = BUILD_BEAM) -> DataFrame:
    """The graph of each shard, a row a point: shard, place in it, start, ids (``k + 1`` smallest of equal vectors), vector, near (places)."""
    points = deal(rows, column, k, shard)
    kind = rows.schema[column].dataType.simpleString()
    schema = f"shard int, place long, start boolean, ids array<bigint>, {column} {kind}, near array<int>"
    return materialize(points.groupBy("shard").applyInArrow(_built(degree, beam, column), schema), "graphs")


def nearest(rows: DataFrame, is_query: str, *, k: int = K_NEAREST, column: str = "embedding", shard: int = SHARD, degree: int = DEGREE, build_beam: int = BUILD_BEAM, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner product found for each query.

    Null ids and vectors that are null, zero, or hold null or non-finite components take no part. All
    vectors must have one length; another is an error. Equal vectors are one point of the graph and
    all answer. A repeated vec_id with one vector is one row; with several it is several points, and a
    query for each of them. An empty table gives an empty result.
    """
    sound = sound_vectors(rows, column).dropDuplicates(["vec_id", column])
    table = graphs(sound, k=k, column=column, shard=shard, degree=degree, beam=build_beam)
    shards = (table.agg(F.max("shard")).head()[0] or 0) + 1
    queries = sound.filter(is_query).select("vec_id", column)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    # a graph goes to each block of queries once
    left = table.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("long").alias("query"), "place", "start", "ids", column, "near")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("place", "long"), ("start", "boolean"), ("ids", "array<bigint>"))]
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block, F.col("vec_id").alias("query"), *none, column, F.lit(None).cast("array<int>").alias("near"))
    found = left.unionByName(right).groupBy("shard", "block").applyInArrow(_asked(k, beam, column), "query_id long, vec_id long, score double")
    return best_of(found, k, "score", True)


def op9_graph_search(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), f"vec_id % {EVERY} = 0")


QUERIES = {"op9_graph_search": op9_graph_search}
