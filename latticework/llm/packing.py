"""Packing documents into windows: non-negative least squares on the length histogram.

A document of n ids is cut into full windows, one body whose length is a multiple of ``grid`` and a
tail shorter than that. Shallow combinations of bodies (up to ``depth``) that fill a window exactly
are enumerated; how often each is used is solved by non-negative least squares against the histogram
and rounded down; what is left, tails included, is packed greedily, longest first. All of that works
on the histogram alone. A full window is a sequence by itself; the other pieces find their places by
their rank among those of equal length.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .tokenkit import encoded

WINDOW, GRID, DEPTH, END = 2048, 16, 3, 1
#: pieces of one length that are ranked in one task, about; groups of one length at most
RANKED, SALTS = 1_000_000, 4096


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of 2 to ``depth`` positive numbers that sum to ``units``."""
    out, stack = [], [((), units, units - 1)]
    while stack:
        head, rest, top = stack.pop()
        if not rest:
            out.append(head)
        elif len(head) < depth:
            left = depth - len(head)
            stack += [((*head, x), rest - x, x) for x in range(-(-rest // left), min(rest, top) + 1)]
    return sorted((c for c in out if len(c) > 1), reverse=True)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """argmin of the norm of ``a x - b`` over x >= 0, by the active-set method of Lawson and Hanson.

    It ends by itself; after ``rounds`` (30 a column) without an end, which rounding errors may cause, it
    warns and returns what it has: feasible, and the greedy part packs what it leaves.
    """
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a, a.T @ b
    tiny = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(30 * n if rounds is None else rounds):
        slope = right - gram @ x
        slope[active] = -np.inf
        j = int(slope.argmax()) if n else 0
        if not n or slope[j] <= tiny:
            return x
        active[j] = True
        while True:
            idx = np.flatnonzero(active)
            s = np.linalg.lstsq(gram[np.ix_(idx, idx)], right[idx], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[idx] = s
                break
            low = s <= 0
            step = (x[idx][low] / np.maximum(x[idx][low] - s[low], 1e-300)).min()
            x[idx] += step * (s - x[idx])
            gone = idx[(x[idx] <= tiny * 1e-3) | (low & (x[idx] <= 1e-12))]
            if not len(gone):
                gone = idx[low][:1]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    if n:
        warnings.warn("the non-negative least squares did not come to an end", stacklevel=2)
    return x


def plan(histogram: dict[int, int], *, window: int = WINDOW, grid: int = GRID, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of piece lengths and how many sequences use each; uses up the histogram exactly."""
    left = {k: v for k, v in histogram.items() if v}
    out = []
    bodies = sorted({k // grid for k in left if k < window and k % grid == 0})
    combos = [c for c in combinations(window // grid, depth) if all(x in set(bodies) for x in c)]
    if combos:
        row = {x: i for i, x in enumerate(bodies)}
        a = np.zeros((len(bodies), len(combos)))
        for j, c in enumerate(combos):
            for x in c:
                a[row[x], j] += 1
        times = nnls(a, np.array([left[x * grid] for x in bodies], float))
        for j in np.argsort(-times, kind="stable"):
            need = {x * grid: combos[j].count(x) for x in combos[j]}
            m = min(int(times[j] + 1e-6), *(left.get(k, 0) // c for k, c in need.items()))
            if m > 0:
                out.append((tuple(x * grid for x in combos[j]), m))
                for k, c in need.items():
                    left[k] -= m * c
    left = {k: v for k, v in left.items() if v}
    lengths = sorted(left, reverse=True)
    while lengths:
        gap, combo = window, []
        for k in lengths:
            take = min(left[k], gap // k)
            combo += [k] * take
            gap -= take * k
            if not gap:
                break
        m = min(left[k] // combo.count(k) for k in set(combo))
        out.append((tuple(combo), m))
        for k in set(combo):
            left[k] -= m * combo.count(k)
        lengths = [k for k in lengths if left[k]]
    return out


def _cut(path: str, by_word: bool, end: int, window: int, grid: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() + 1) << 36  # of a full window: its own in all tasks
        for batch in batches:
            for lo, _, ids, bounds in encoded(batch.column(1), path, by_word, end):
                raw = ids.astype("<u4").tobytes()
                rows: list[list] = [[], [], [], [], [], [], []]
                docs = batch.column(0)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    n = b - a
                    cuts = [*range(0, n - window + 1, window)]
                    rest = len(cuts) * window
                    body = (n - rest) // grid * grid
                    cuts += ([rest] if body else []) + ([rest + body] if rest + body < n else [])
                    for s, e in zip(cuts, [*cuts[1:], n], strict=True):
                        piece = raw[4 * (a + s) : 4 * (a + e)]
                        full = number if e - s == window else None
                        number += full is not None
                        for column, value in zip(rows, (docs[lo + i].as_py(), s, e - s, zlib.crc32(piece), n, full, piece if keep_ids else None), strict=True):
                            column.append(value)
                kinds = [pa.int64()] * 6 + [pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "full", "ids"]
                yield pa.RecordBatch.from_arrays(arrays[: 7 if keep_ids else 6], names[: 7 if keep_ids else 6])

    return run


def pack(docs: DataFrame, path: str, *, by_word: bool = True, end: int = END, window: int = WINDOW, grid: int = GRID, depth: int = DEPTH, keep_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``docs`` needs doc_id and text; null text: the end id alone. Each id lies in one piece; a sequence
    holds at most ``window`` ids, without gaps from 0. A null doc_id is a document like any other, and
    so is each of several rows with one doc_id. An empty table gives an empty result.

    Sequence ids are the plan's from 0 on, and for full windows numbers from 2**36 on that no other task
    gives. The histogram and the plan go through the driver: at most ``window`` lengths and, with these, a
    few thousand rows, whatever the input. A length that very many pieces have is dealt over groups of
    about ``RANKED`` pieces for ranking.
    """
    spark = docs.sparkSession
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, full long" + ", ids binary" * keep_ids
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(text.mapInArrow(_cut(path, by_word, end, window, grid, keep_ids), schema), "pieces")
    rest = pieces.filter("full is null")
    histogram = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, used, base = [], dict.fromkeys(histogram, 0), 0
    for combo, m in plan(histogram, window=window, grid=grid, depth=depth):
        at = 0
        for k in sorted(set(combo), reverse=True):
            each = combo.count(k)
            slots.append((k, used[k], used[k] + m * each, base, each, at))
            used[k] += m * each
            at += each * k
        base += m
    names = ("length", "rank_from", "rank_to", "base", "each", "at")
    # from Arrow: rows of Python objects would start workers of another kind on the executors, beside those that encode
    table = spark.createDataFrame(pa.table({n: pa.array([s[i] for s in slots], pa.int64()) for i, n in enumerate(names)}))

    salts = min(SALTS, max(64, -(-max(histogram.values(), default=0) // RANKED)))
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32")]
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    # length and salt: (window / grid + grid) * SALTS rows at most
    ranked = ranked.join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))).drop(table["length"])
    nth = F.col("rank") - F.col("rank_from")
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - rank_from) div each")).withColumn("offset", F.col("at") + nth % F.col("each") * F.col("length"))
    whole = pieces.filter("full is not null").withColumn("sequence_id", F.col("full")).withColumn("offset", F.lit(0).cast("long"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    return placed.select(*names).unionByName(whole.select(*names))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


QUERIES = {"op6_packing": op6_packing}
