"""Quality selection by importance resampling with hashed n-gram models.

Words and word pairs are hashed into buckets. One bag-of-buckets model is fitted to the target texts,
one to all texts; a document's log importance weight is the sum of the logarithms of their ratio over all
its n-grams. Adding Gumbel noise to the log weights and taking the ``k`` largest samples without
replacement by the weights. ``temper`` is another, named choice: the mean over the n-grams times that
number, by which a text's length doesn't count.

The model of all texts counts every document. That of the target is fitted to at most ``targets``
target documents, those with the least hashes of their ids, so that only their ids are broadcast and
no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .storage import materialize

BUCKETS, SMOOTH = 1 << 18, 0.5
#: at most so many labelled target documents are fitted; their ids are broadcast
TARGETS = 1 << 16


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs; the document of each."""
    (hashes,), bounds = K.words(data, offsets)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    both = owner[1:] == owner[:-1]
    pairs = K.mix(hashes[:-1] * K.BASE + hashes[1:])[both]
    cell = np.concatenate((hashes, pairs)) % np.uint64(buckets)
    return cell.astype(np.int64), np.concatenate((owner, owner[1:][both]))


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(0)):
                aim = np.array(batch.column(1)[lo:hi].to_pylist(), bool)
                cell, owner = features(data, offsets, buckets)
                total[0] += np.bincount(cell, minlength=buckets)
                total[1] += np.bincount(cell[aim[owner]], minlength=buckets)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["bucket", "raw", "target"])

    return run


def fitted_targets(target_ids: DataFrame, targets: int) -> DataFrame:
    """(doc_id): all target documents, or ``targets`` of them, chosen by a hash of the id."""
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    total = ids.count()
    if total <= targets:
        return ids
    # thinned to a few more than wanted first, so that the last choice is among a bounded number
    h = F.xxhash64("doc_id", F.lit("target"))
    least = F.pmod(h, F.lit(1 << 40)) < int((targets + 6 * targets**0.5) / total * (1 << 40))
    return ids.filter(least).orderBy(F.pmod(h, F.lit(1 << 40)), "doc_id").limit(targets)


def ratios(docs: DataFrame, target_ids: DataFrame, *, buckets: int = BUCKETS, smooth: float = SMOOTH, targets: int = TARGETS) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | all) from all documents; one number a bucket reaches the driver."""
    aims = F.broadcast(fitted_targets(target_ids, targets).withColumn("aim", F.lit(True)))
    marked = docs.select("doc_id", "text").join(aims, "doc_id", "left").select("text", F.coalesce("aim", F.lit(False)).alias("aim"))
    rows = marked.mapInArrow(_count(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(buckets)
    prior = raw / raw.sum() if raw.sum() else raw
    # smoothed towards the raw model: a bucket that was never seen says nothing
    fitted = (target + smooth * prior * len(prior) / 1024 + smooth) / (target.sum() + smooth * len(prior) / 1024 + smooth * len(prior))
    base = (raw + smooth) / (raw.sum() + smooth * len(raw))
    return np.where(raw > 0, np.log(fitted / base), 0.0)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """``scored`` (doc_id, key, ...) with kept: true for the ``k`` largest keys, ties to the smaller doc_id.

    The k-th largest is found exactly from counts of 16-bit prefixes: at most 65536 rows a round reach
    the driver. Rows equal in both key and doc_id are kept or left together.
    """
    ranked = scored.withColumn("level", F.floor(F.col("key") * 1e9).cast("long"))

    def bound(rows: DataFrame, column: str, k: int, descending: bool) -> tuple[int, int]:
        """The k-th value of a long column, and how many rows come strictly before it."""
        row = rows.agg(F.min(column), F.max(column)).head()
        low, high, before = row[0], row[1], 0
        while low < high:
            width = max(1, -(-(high - low + 1) // 65536))
            cell = F.expr(f"({column} - ({low})) div {width}")
            counts = {r["c"]: r["n"] for r in rows.filter(F.col(column).between(low, high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n")).collect()}
            for c in sorted(counts, reverse=descending):
                if before + counts[c] >= k:
                    break
                before += counts[c]
            low, high = low + c * width, min(high, low + (c + 1) * width - 1)
        return low, before

    total = scored.count()
    if k >= total:
        return scored.withColumn("kept", F.lit(True))
    if k <= 0:
        return scored.withColumn("kept", F.lit(False))
    level, above = bound(ranked, "level", k, True)
    tied = ranked.filter(F.col("level") == level)
    last, _ = bound(tied, "doc_id", k - above, False)
    return ranked.withColumn("kept", (F.col("level") > level) | ((F.col("level") == level) & (F.col("doc_id") <= last))).drop("level")


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float, *, buckets: int = BUCKETS, temper: float | None = None, seed: int = 1, targets: int = TARGETS) -> DataFrame:
    """One row a document: doc_id, log_weight, key (with Gumbel noise), kept for ``fraction`` of all rows.

    ``docs``: doc_id, text; ``target_ids``: doc_id of the target texts, of which at most ``targets``
    are fitted. Null or blank text: weight 0 on the log scale. ``temper``: None for the summed log
    ratios, a number for their mean times it. The noise is a function of doc_id and ``seed``, so a lost task gives the same rows
    again. Without target texts all weights are equal. A null doc_id takes no part and is left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(ratios(docs, target_ids, buckets=buckets, targets=targets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                cell, owner = features(data, offsets, buckets)
                weight = np.bincount(owner, shared.value[cell], hi - lo)
                if temper is not None:
                    weight = temper * weight / np.maximum(np.bincount(owner, minlength=hi - lo), 1)
                ids = batch.column(0)[lo:hi].to_numpy(zero_copy_only=False)
                u = (K.mix(ids.astype(np.int64).view(np.uint64) ^ K.stream(seed, 9)[-1]) >> np.uint64(11)).astype(float) / (1 << 53)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(weight), pa.array(weight - np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16))))], ["doc_id", "log_weight", "key"])

    scored = materialize(docs.mapInArrow(run, "doc_id long, log_weight double, key double"), "scored")
    return top_k(scored, int(fraction * scored.count()))


def op8_quality_resampling(spark, sf_dir: str) -> DataFrame:
    """The target: documents labelled good and not toxic; kept: as large a share as that has among the labelled."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    fraction = labels.agg(F.avg(F.coalesce(good.cast("double"), F.lit(0.0)))).head()[0]
    return resample(docs, labels.filter(good), 1.0 if fraction is None else fraction)


QUERIES = {"op8_quality_resampling": op8_quality_resampling}
