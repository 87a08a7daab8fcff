"""Language identification with language-bitmask n-gram filters.

Character n-grams of lower-cased letters (everything else is a gap) are counted per language over all
training documents. A bit-sliced Bloom filter holds every n-gram seen: the AND of an n-gram's slots is
the set of all languages that contain it, one bit a language. Beside the slice of a language there are
slices for the n-grams that make up at least ``LEVELS[1]``, ``LEVELS[2]``, ... of its n-grams. A text's
n-grams are looked up, the bits of each slice are counted, the counts are corrected for the slice's false
positives, and the language with the largest sum over its slices wins: containment alone would let a
language win that has a rare n-gram in one stray text, the more of these the larger the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .storage import discard, materialize

ORDERS, HASHES, SLOTS_PER_GRAM = (3, 4), 3, 16
#: least share of a language's n-grams for each of its slices; the first slice holds all it contains
LEVELS = (0.0, 2.0**-19, 2.0**-16, 2.0**-13)
#: a filter takes this many bytes at most. With more n-grams than fit at ``SLOTS_PER_GRAM`` all of them are still in it, and its false positives rise
FILTER_BYTES = 1 << 28
#: code points in work at once; slots that one task gathers
PART, SEGMENT = 1 << 18, 1 << 16
#: pending n-grams of a language that are merged with those counted already
PENDING = 1 << 18
_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _alpha


def grams(texts: list[str | None], orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of (n-gram hashes, whether an n-gram has a letter, the text of each); texts follow one another."""
    gap = max(orders) - 1
    low = [(t or "").lower() for t in texts]
    ends = np.cumsum([gap + len(t) for t in low])  # a text's n-grams start in its gap or in itself
    pad = "\0" * gap
    points = np.frombuffer("".join([*(pad + t for t in low), pad]).encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, int(ends[-1]) if len(ends) else 0, PART):
        size = min(PART, int(ends[-1]) - at)
        near = points[at : at + size + gap]
        solid = _letters()[near]
        code = np.where(solid, near, 0).astype(np.uint64)
        owner = np.searchsorted(ends, np.arange(at, at + size), "right") if len(texts) > 1 else np.zeros(size, np.int64)
        for n in orders:
            h, some = np.full(size, n, np.uint64), np.zeros(size, bool)
            for k in range(n):
                h = h * K.BASE + code[k : k + size]
                some |= solid[k : k + size]
            yield K.mix(h), some, owner


def _text_chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str | None]]]:
    for lo, hi, _, _ in K.chunks(batch.column(column), PART):
        yield lo, hi, batch.column(column)[lo:hi].to_pylist()


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return [(keys, np.bincount(place, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64))]


def _count(orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for lo, hi, texts in _text_chunks(batch, 1):
                langs = batch.column(0)[lo:hi].to_pylist()
                for lang in set(langs):
                    parts = found.setdefault(lang, [])
                    for hashes, some, _ in grams([t for t, x in zip(texts, langs, strict=True) if x == lang], orders):
                        parts.append(np.unique(hashes[some], return_counts=True))
                        if sum(len(k) for k, _ in parts[1:]) > max(PENDING, len(parts[0][0])):
                            parts[:] = _merge(parts)
        for lang, parts in found.items():
            ((keys, counts),) = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    return run


def slots_of(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The slots of each n-gram; ``size`` is a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield ((hashes + step * np.uint64(i)) & np.uint64(size - 1)).astype(np.int64)


@dataclass(frozen=True)
class Filter:
    """Words of slots (words x slots) with ``levels`` bits a language, a language's bits in one word; ``wrong``: false-positive rate of each slice (languages x levels)."""

    langs: tuple[str, ...]
    slots: np.ndarray
    wrong: np.ndarray
    default: str
    orders: tuple[int, ...] = ORDERS

    @property
    def levels(self) -> int:
        return self.wrong.shape[1]

    def place(self, lang: int) -> tuple[int, int]:
        """Word and first bit of a language."""
        room = self.slots.dtype.itemsize * 8 // self.levels
        return lang // room, lang % room * self.levels

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        out = None
        for at in slots_of(hashes, self.slots.shape[1]):
            part = self.slots[:, at]
            out = part if out is None else out & part
        return out

    def contains(self, hashes: np.ndarray, lang: int) -> np.ndarray:
        word, bit = self.place(lang)
        return (self.masks(hashes)[word] >> self.slots.dtype.type(bit)) & self.slots.dtype.type(1) == 1

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams with a letter of each text, and bits set for them (languages x levels x texts)."""
        total = np.zeros(len(texts), np.int64)
        hits = np.zeros((*self.wrong.shape, len(texts)), np.int64)
        kind = self.slots.dtype.type
        for hashes, some, owner in grams(texts, self.orders):
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            who = owner[heads]
            total[who] += np.add.reduceat(some, heads, dtype=np.int64)
            masks = self.masks(hashes) * some.astype(kind)
            for i in range(len(self.langs)):
                word, bit = self.place(i)
                for v in range(self.levels):
                    hits[i, v, who] += np.add.reduceat((masks[word] >> kind(bit + v)) & kind(1), heads, dtype=np.int64)
        return total, hits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and the corrected share of its n-grams that the language contains."""
        n, hits = self.counts(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        wrong = np.minimum(self.wrong, 1 - 1e-9)[:, :, None]
        true = np.maximum(0, hits - n * wrong) / (1 - wrong)
        best = true.sum(1).argmax(0)
        share = np.minimum(1.0, true[best, 0, np.arange(len(texts))] / np.maximum(n, 1))
        return ["und" if not n[j] else self.langs[best[j]] if share[j] > 0 else self.default for j in range(len(texts))], share


def _bits(langs: tuple[str, ...], totals: dict[str, int], levels: tuple[float, ...], size: int, room: int):
    """Of rows (lang, gram, n): the bits that they set, by word and segment of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            lang = np.array([code[x] for x in batch.column(0).to_pylist()], np.int64)
            share = batch.column(2).to_numpy() / np.array([totals[x] for x in langs], float)[lang]
            reached = sum((share >= t).astype(np.int64) for t in levels)
            mask = ((np.uint64(1) << reached.astype(np.uint64)) - np.uint64(1)) << (lang % room * len(levels)).astype(np.uint64)
            for at in slots_of(batch.column(1).to_numpy().view(np.uint64), size):
                yield pa.RecordBatch.from_arrays([pa.array(lang // room), pa.array(at // SEGMENT), pa.array(at % SEGMENT), pa.array(mask.view(np.int64))], ["word", "segment", "slot", "mask"])

    return run


def _gathered(kind: str):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.zeros(SEGMENT, np.uint64)
        np.bitwise_or.at(out, rows.column("slot").to_numpy(), rows.column("mask").to_numpy().view(np.uint64))
        return pa.table({"word": [key[0].as_py()], "segment": [key[1].as_py()], "bits": pa.array([out.astype(kind).tobytes()], pa.binary())})

    return run


def learn(docs: DataFrame, *, orders: tuple[int, ...] = ORDERS, levels: tuple[float, ...] = LEVELS, filter_bytes: int = FILTER_BYTES) -> Filter:
    """The filter of all documents (lang, text) whose lang and text are not null; any number of languages.

    Every n-gram of every document is in it. What reaches the driver is the number of n-grams of each
    language and the filter itself, gathered in segments in the cluster: ``filter_bytes`` at most.
    """
    counts = docs.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(_count(orders), "lang string, gram long, n long")
    counts = materialize(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    rows = counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect()
    totals = {r["lang"]: r["n"] for r in rows}
    langs = tuple(sorted(totals))
    if not langs:
        discard(counts)
        return Filter((), np.zeros((1, 1), np.uint8), np.zeros((0, len(levels))), "und", orders)
    kind = next((k for k in ("<u1", "<u2", "<u4", "<u8") if np.dtype(k).itemsize * 8 >= len(langs) * len(levels)), "<u8")
    room = np.dtype(kind).itemsize * 8 // len(levels)
    words = -(-len(langs) // room)
    wanted = max(SEGMENT, 1 << (SLOTS_PER_GRAM * max(r["different"] for r in rows) * min(2, len(langs))).bit_length())
    size = min(wanted, 1 << max(1, filter_bytes // (words * np.dtype(kind).itemsize)).bit_length() - 1)
    size = max(size, SEGMENT)
    bits = counts.mapInArrow(_bits(langs, totals, levels, size, room), "word long, segment long, slot long, mask long")
    parts = bits.groupBy("word", "segment").applyInArrow(_gathered(kind), "word long, segment long, bits binary")
    slots = np.zeros((words, size), kind)
    for r in parts.collect():
        slots[r["word"], r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(r["bits"], kind)
    discard(counts)
    found = Filter(langs, slots, np.zeros((len(langs), len(levels))), max(sorted(totals), key=totals.get), orders)
    one = slots.dtype.type(1)
    for i in range(len(langs)):
        word, bit = found.place(i)
        for v in range(len(levels)):
            found.wrong[i, v] = ((slots[word] >> slots.dtype.type(bit + v)) & one).mean() ** HASHES
    return found


def identify(docs: DataFrame, known: Filter) -> DataFrame:
    """``docs`` with lang_pred and score; only text is looked at.

    Null text, or text without a letter: ``und`` with score 0. A text none of whose n-grams is known gets
    the most frequent learned language with score 0. Ties go to the smaller language. Columns that are
    called lang_pred or score already are replaced. Rows that repeat come out as often as they came in;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)
    base = docs.drop("lang_pred", "score")
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for lo, hi, texts in _text_chunks(batch, at):
                langs, score = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns), pa.array(langs, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(run, schema)


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def learned_of(docs: DataFrame) -> Filter:
    return learn(docs.filter(f"not coalesce({HELD_OUT}, true)"))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = learned_of(docs)
    out = identify(docs.select("doc_id", "text"), known)
    return out.select("doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
