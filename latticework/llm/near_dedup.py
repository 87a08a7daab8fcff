"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A sketch has ``t = rows * bands`` coordinates. In round ``i < t`` every element falls into one hashed
bin with the value ``(i, hash)``; in round ``t + j`` every element falls into bin ``j``. A coordinate
holds its least value, so after 2t rounds every one is filled, nearly always after a few, and the
share of equal coordinates of two sets concentrates around their Jaccard similarity.

Bands of ``rows`` coordinates propose links between classes of equal sets; every link is confirmed on
the full sets. In a bucket of similar texts one hub is compared with all members, links are merged
into components, and only members outside the bucket's main component are then compared with the
others, first with one, then with all whose sets can still share enough by two exact bounds (elements
that no other set has, and a bitmap of each set): work is linear in a bucket's size but for members
that nearly reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .graph import connected_components
from .skew import join_keyed
from .storage import discard, materialize

WIDTH, PERCENT, ROWS, BANDS, FIRST_BANDS = 5, 75, 5, 40, 6
#: 64-bit words of the bitmap that bounds what two sets can share
MARKS = 64
_EMPTY = np.iinfo(np.uint64).max


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches, one row of ``t`` coordinates a set; sets are not empty."""
    out = np.full(len(sets) * t, _EMPTY, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, values = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    seeds = K.stream(2 * t, 3)
    for i in range(2 * t):
        if not len(values):
            break
        h = K.mix(values ^ seeds[i])
        low = h & np.uint64(0xFFFFFFFF)
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, low | np.uint64(i << 32))
        open_ = (out.reshape(-1, t) == _EMPTY).any(1)
        if not open_.all():
            still = open_[owner]
            owner, values = owner[still], values[still]
    return out.reshape(-1, t)


def _features(rows: int, bands: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                sets, again = K.both_sets(data, offsets, width)
                # by both hashes: equal keys are equal sets
                keys = [xxhash.xxh3_128_digest(s.tobytes() + t.tobytes()) for s, t in zip(sets, again, strict=True)]
                full = [s for s in sets if len(s)]
                sk = sketch(full, rows * bands).reshape(-1, bands, rows)
                factor = K.stream(rows, 4) | np.uint64(1)
                tags = K.mix((sk * factor).sum(2, dtype=np.uint64) + K.stream(bands, 5)).view(np.int64)
                bounds = np.concatenate(([0], np.cumsum([bands * bool(len(s)) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array([max(len(s), len(t)) for s, t in zip(sets, again, strict=True)], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(tags.reshape(-1)))],
                    ["doc_id", "n_shingles", "set_key", "tags"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(1)):
                # the hash that the sketches do not use: no pair is confirmed by a collision that proposed it
                sets = K.shingle_sets(data, offsets, width, lane=1)
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                bits = np.zeros((len(sets), 64 * MARKS), bool)
                bits[np.repeat(np.arange(len(sets)), np.diff(bounds)), flat % np.uint64(64 * MARKS)] = True
                marks = np.packbits(bits, 1).view(np.int64).reshape(-1)
                columns = [batch.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64)))]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * MARKS), pa.array(marks))], ["doc_id", "elements", "marks"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b), those whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb"))
    right = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea"))
    both = pairs.join(left, "b").join(right, "a")
    shared = F.size(F.array_intersect("ea", "eb"))
    return both.filter(100 * shared >= percent * (F.size("ea") + F.size("eb") - shared)).select("a", "b")


def _useful(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, useful): how many elements of each of these sets occur in another one of them.

    No two of the sets can share more than the lesser of these numbers, an exact bound that spares
    the comparison of texts which resemble many others but not closely enough.
    """
    own = sets.join(ids, "doc_id").select(F.col("doc_id").alias("id"), "elements")
    alone = own.select("id", F.explode("elements").alias("e")).groupBy("e").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1")
    alone = alone.groupBy("id").agg(F.count("*").alias("alone"))
    return own.select("id", F.size("elements").alias("n")).join(alone, "id", "left").select("id", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("useful"))


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, first_bands: int = FIRST_BANDS) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id, component_id, kept.

    ``docs`` needs doc_id and text; other columns are not read. Null or blank text: an empty set,
    linked with nothing. Fewer than ``width`` words: the whole sequence is the one element. Equal sets
    form a class (class_id: its least doc_id); component_id is the least doc_id reachable, kept is
    true for that document. A null doc_id takes no part and is left out; rows that repeat a doc_id must
    repeat its text and come out as often as they came in. An empty table gives an empty result.
    """
    docs = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("tags", T.ArrayType(T.LongType()))])
    features = materialize(docs.mapInArrow(_features(rows, bands, width), schema), "features")
    total = features.count()
    classes = features.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"))
    members = join_keyed(features.select("doc_id", "n_shingles", "set_key"), classes, ["set_key"], "size", total, "left")
    members = materialize(members.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")), "classes")
    # a class's tags and size: the same in all its members
    heads = features.filter("n_shingles > 0").join(members.filter("doc_id = class_id").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    tags = heads.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.posexplode("tags").alias("band", "tag"))
    met = tags.groupBy("band", "tag").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("first")).filter("size > 1")
    met = met.select("band", "tag", "size", F.col("first.id").alias("hub"), F.col("first.n").alias("hub_n"))
    buckets = materialize(join_keyed(tags, met, ["band", "tag"], "size", total * bands), "buckets")
    discard(features)

    ids = buckets.select(F.col("id").alias("doc_id")).distinct()
    sets_of = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("elements", T.ArrayType(T.LongType())), T.StructField("marks", T.ArrayType(T.LongType()))])
    # one row a doc_id, by the join's own partitions
    texts = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = materialize(texts.mapInArrow(_sets(width), sets_of), "sets")

    near = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    first = buckets.filter("id > hub").filter(F.col("band") < first_bands).filter(near)
    first = materialize(first.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "tried")
    links = materialize(_confirmed(first, sets, percent), "confirmed")
    parts = materialize(connected_components(links), "parts")

    tried, useful = first, None
    for step in ("hub", "rest"):
        label = F.coalesce("component", "id").alias("part")
        named = buckets.select("band", "tag", "id", "n").join(parts.withColumnRenamed("node", "id"), "id", "left").select("band", "tag", "id", "n", label)
        # the main component of a bucket: that of its largest part, ties to the least
        sizes = named.groupBy("band", "tag", "part").agg(F.count("*").alias("m"), F.min_by("id", F.xxhash64("id", "band")).alias("head"))
        main = sizes.groupBy("band", "tag").agg(F.count("*").alias("parts"), F.sum("m").alias("size"), F.max_by(F.struct("part", "head"), F.struct("m", -F.col("part"))).alias("main")).filter("parts > 1").withColumn("members", F.col("size"))
        mixed = join_keyed(named, main, ["band", "tag"], "size", total * bands)
        if useful is None:
            useful = materialize(_useful(mixed.select(F.col("id").alias("doc_id")).distinct(), sets), "useful")
        mixed = materialize(mixed.join(useful, "id").filter(f"100 * useful >= {percent} * n"), "mixed")
        outside = mixed.filter("part <> main.part").drop("members")
        # sets share at most their useful elements; a link needs percent / (100 + percent) of both sizes together
        close = f"{near} and {100 + percent} * least(useful, hub_useful) >= {percent} * (n + hub_n)"
        other = mixed.select("band", "tag", F.col("id").alias("other"), F.col("n").alias("hub_n"), F.col("useful").alias("hub_useful"), F.col("part").alias("other_part"), F.col("main.head").alias("head"), "members")
        if step == "hub":  # those outside against one member a bucket, of its main part
            pairs = join_keyed(outside, other.filter("other = head"), ["band", "tag"], "members", total * bands).filter(close)
        else:  # those still outside against every member of another part
            marks = sets.select(F.col("doc_id").alias("id"), "marks")
            outside = outside.join(marks, "id")
            other = other.join(marks.select(F.col("id").alias("other"), F.col("marks").alias("other_marks")), "other")
            only = "aggregate(zip_with(marks, other_marks, (x, y) -> bit_count({})), 0, (s, x) -> s + x)"
            shared = f"least(n - {only.format('x & ~y')}, hub_n - {only.format('y & ~x')})"
            pairs = outside.join(other, ["band", "tag"]).filter(f"part <> other_part and {close} and {100 + percent} * {shared} >= {percent} * (n + hub_n)")
        pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        pairs = materialize(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "tried")
        more = materialize(_confirmed(pairs, sets, percent), "confirmed")
        tried = tried.unionByName(pairs)
        if not more.isEmpty():
            # the components' stars link the same nodes as the links they were made of
            stars = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
            parts = materialize(connected_components(stars.unionByName(more)), "parts")
        discard(mixed)
    discard(sets, useful, buckets)

    out = members.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.coalesce("component", "class_id")
    return out.select("doc_id", "n_shingles", "class_id", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_near_dedup": op1_near_dedup}
ORACLES = {
    "op1_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(v) = 0 THEN []::VARCHAR[] WHEN len(v) < 5 THEN [array_to_string(v, ' ')]
    ELSE list_distinct(list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
k AS (SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) = 0 THEN doc_id::VARCHAR ELSE md5(array_to_string(list_sort(sh), chr(10))) END AS key FROM s),
c AS (SELECT key, min(doc_id) AS class_id, min(n) AS n FROM k GROUP BY key),
ce AS (SELECT c.class_id, c.n, e.g FROM c JOIN e ON e.doc_id = c.class_id),
p AS (
  SELECT x.class_id AS a, y.class_id AS b FROM ce x JOIN ce y ON x.g = y.g AND x.class_id < y.class_id
  WHERE 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)
  GROUP BY x.class_id, y.class_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, root) AS (
  SELECT class_id, class_id FROM c
  UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b
), m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT k.doc_id, k.n AS n_shingles, c.class_id, m.root AS component_id, k.doc_id = m.root AS kept
FROM k JOIN c USING (key) JOIN m ON m.node = c.class_id
"""
}
