"""Token ids as a binary corpus: static range asymmetric numeral coding in independent blocks.

Texts are tokenized once, in ascending doc_id order within range partitions (shards). One frequency
table of all ids, scaled to 2**20, serves every block. A block holds whole documents of one shard and
is coded by ``LANES`` interleaved coders with 64-bit states; id ``i`` of a block belongs to lane
``i % LANES``. Every ``RESTART`` steps the lanes' states and the place in the word stream are kept; the
reader starts at all of a block's checkpoints at once and decodes them side by side, or only those that
cover the documents asked for. Each block carries a checksum.

A corpus is a folder with two Parquet tables, all that a later job needs to read it:

- ``frequencies``: id, frequency (sums to 2**20), one row an id that occurs;
- ``blocks``: a folder a shard (``shard=0`` and so on, by ascending doc_id), in its files block rows by
  ascending ``start`` (ids before the block): first_doc, last_doc, n_docs, n_tokens, docs and sizes (little-endian 64-bit doc_ids and numbers of
  ids), payload, checksum (CRC-32 of the payload). The payload: five 64-bit numbers (ids, lanes, steps
  between checkpoints, words, checkpoints), the checkpoints (place in the words, then the lanes' states), the 32-bit words.

Spark's commit protocol makes the write survive lost executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, materialize, new_folder
from .tokenkit import encoded, vocabulary

BITS, LANES, BLOCK, RESTART, END = 20, 512, 1 << 18, 128, 2
_LOW = np.uint64(1 << 31)


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to ``2**bits``, at least 1 for every id that occurs."""
    total, goal = int(counts.sum()), 1 << bits
    if not total:
        return counts.astype(np.int64)
    used = counts > 0
    if used.sum() > goal:
        raise ValueError(f"{used.sum()} different ids do not fit a table of {goal}")
    out = np.where(used, np.maximum(1, counts * goal // total), 0).astype(np.int64)
    order = np.argsort(-out, kind="stable")
    rest = goal - int(out.sum())
    while rest:  # the common ids bear the rounding
        for i in order:
            step = rest if rest > 0 else max(rest, 1 - int(out[i]))
            out[i] += step
            rest -= step
            if not rest:
                break
    return out


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int = LANES, restart: int = RESTART) -> bytes:
    """Header (ids, lanes, restart, words, checkpoints), checkpoints (word position, states), words."""
    n = len(ids)
    steps = -(-n // lanes)
    filled = np.concatenate([ids, np.full(steps * lanes - n, ids[-1])]).reshape(steps, lanes) if n else np.zeros((0, lanes), np.int64)
    f, c = freq[filled].astype(np.uint64), start[filled].astype(np.uint64)
    top, rest = f << np.uint64(63 - BITS), np.uint64(1 << BITS) - f
    x = np.full(lanes, _LOW, np.uint64)
    words, marks, behind = [], [], 0
    for s in range(steps - 1, -1, -1):
        full = x >= top[s]
        out = x[full].astype("<u4")  # the low halves
        words.append(out)
        behind += len(out)
        np.right_shift(x, np.uint64(32), out=x, where=full)
        # quotient << BITS, plus remainder, plus start
        q = x // f[s]
        q *= rest[s]
        x += q
        x += c[s]
        if s % restart == 0:
            marks.append((behind, x.copy()))
    head = np.array([n, lanes, restart, behind, len(marks)], "<u8").tobytes()
    points = b"".join(np.uint64(behind - b).tobytes() + states.astype("<u8").tobytes() for b, states in reversed(marks))
    return head + points + b"".join(w.tobytes() for w in reversed(words))


def decode_block(payload: bytes, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray, first: int = 0, last: int | None = None) -> tuple[int, np.ndarray]:
    """The ids of a block from ``first`` up to ``last``: those of all checkpoints that cover them, and the place of the first id returned.

    The checkpoints are decoded side by side, so the number of steps doesn't grow with the block.
    """
    n, lanes, restart, size, marks = (int(v) for v in np.frombuffer(payload, "<u8", 5))
    span = restart * lanes
    low, high = min(max(first, 0), n) // span, -(-min(n if last is None else last, n) // span)
    if low >= high:
        return 0, np.zeros(0, symbol.dtype)
    points = np.frombuffer(payload, "<u8", marks * (lanes + 1), 40).reshape(marks, lanes + 1)[low:high]
    words = np.frombuffer(payload, "<u4", size, 40 + marks * (lanes + 1) * 8).astype(np.uint64)
    steps = -(-n // lanes)
    at, x = points[:, 0].astype(np.int64), points[:, 1:].astype(np.uint64)
    out = np.empty((high - low, restart, lanes), symbol.dtype)
    mask = np.uint64((1 << BITS) - 1)
    whole = steps - (high - 1) * restart  # the last checkpoint may have fewer steps than the others
    for s in range(restart):
        if s == whole and high == marks:
            at, x = at[:-1], x[:-1]
        if not len(x):
            break
        slot = x & mask
        ids = symbol[slot.astype(np.int64)]
        out[: len(x), s] = ids
        x = freq[ids] * (x >> np.uint64(BITS)) + slot - start[ids]
        low_ = x < _LOW
        row, lane = np.nonzero(low_)
        taken = low_.sum(1)
        # lanes take their words one after another within a checkpoint
        nth = np.arange(len(row)) - np.repeat(np.cumsum(taken) - taken, taken)
        x[row, lane] = (x[row, lane] << np.uint64(32)) | words[at[row] + nth]
        at = at + taken
    return low * span, out.reshape(-1)[: n - low * span]


def tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    freq = freq.astype(np.uint64)
    start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    return freq, start, np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.int32), freq.astype(np.int64))


def _tokenize(path: str, by_word: bool, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for lo, hi, ids, bounds in encoded(batch.column(1), path, by_word, end):
                n = hi - lo
                raw = ids.astype(kind)
                values = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard)), pa.array(np.arange(seq, seq + n)), batch.column(0)[lo:hi], pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), values],
                    ["shard", "seq", "doc_id", "local_start", "n_tokens", "ids"],
                )
                seq, start = seq + n, start + int(bounds[-1])

    return run


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, _ in _raw(batch.column(0)):
                c = np.bincount(np.frombuffer(data, kind))
                if len(c) > len(total):
                    c, total = total, c
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "count"])

    return run


def _raw(column: pa.Array):
    from .textkit import chunks

    for lo, hi, data, offsets in chunks(column, 4 << 20):
        yield lo, hi, data.tobytes(), offsets


def _pack(freq: np.ndarray, offsets: dict[int, int], kind: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, start, _ = tables(freq)

        def closed(rows):
            ids = np.concatenate([r[5] for r in rows])
            payload = encode_block(ids.astype(np.int64), f, start)
            begin = offsets[rows[0][0]] + rows[0][3]
            docs, sizes = np.array([r[2] for r in rows], "<i8").tobytes(), np.array([r[4] for r in rows], "<i8").tobytes()
            row = {"shard": rows[0][0], "start": begin, "first_doc": rows[0][2], "last_doc": rows[-1][2], "n_docs": len(rows), "n_tokens": len(ids), "docs": docs, "sizes": sizes, "payload": payload, "checksum": zlib.crc32(payload)}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCKS_ARROW)

        rows, held = [], 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for i, raw in enumerate(batch.column(5)):
                row = tuple(c[i] for c in cols)
                if rows and (row[0], row[1]) != (rows[-1][0], rows[-1][1] + 1):
                    yield closed(rows)
                    rows, held = [], 0
                rows.append((*row, np.frombuffer(raw.as_buffer(), kind)))
                held += row[4]
                if held >= block:
                    yield closed(rows)
                    rows, held = [], 0
        if rows:
            yield closed(rows)

    return run


_BLOCKS = "shard long, start long, first_doc long, last_doc long, n_docs long, n_tokens long, docs binary, sizes binary, payload binary, checksum long"
_BLOCKS_ARROW = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in _BLOCKS.split(", "))])


def write_blocks(docs: DataFrame, tokenizer: str, folder: str, *, by_word: bool = False, end: int = END, block: int = BLOCK) -> None:
    """Tokenize ``docs`` (doc_id, text) with the file ``tokenizer`` and write the corpus into ``folder``.

    Ids are held in 16 bits where the tokenizer's vocabulary and ``end`` fit, else in 32. Null text:
    empty, so the end id alone. A null doc_id takes no part. Rows that repeat a doc_id are kept, next to
    each other; extra columns are not read. An empty table gives two empty tables.
    """
    kind = "<u2" if max(vocabulary(tokenizer), end + 1) <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    schema = "shard long, seq long, doc_id long, local_start long, n_tokens long, ids binary"
    ids = materialize(ordered.mapInArrow(_tokenize(tokenizer, by_word, end, kind), schema), "ids")
    # both go to the driver: one row an id of the vocabulary, and one row a shard
    counts = ids.select("ids").mapInArrow(_count(kind), "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).collect()
    sizes = ids.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    total = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        total[r["id"]] = r["count"]
    freq, offsets, at = scaled(total), {}, 0
    for r in sizes:
        offsets[r["shard"]] = at
        at += r["n"]
    used = np.flatnonzero(freq)
    spark.createDataFrame(pa.table({"id": used.astype(np.int64), "frequency": freq[used].astype(np.int64)})).coalesce(1).write.parquet(f"{folder}/frequencies")
    # a shard's ids are a file with one group of rows, so one task reads them in order: nothing is shuffled
    blocks = ids.mapInArrow(_pack(freq, offsets, kind, block), _BLOCKS)
    blocks.sortWithinPartitions("shard", "start").write.partitionBy("shard").parquet(f"{folder}/blocks")
    discard(ids)


def read_blocks(spark: SparkSession, folder: str, *, digest: bool = True, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """One row a document read back from ``folder``: doc_id, start, n_tokens, and ids_crc32 or ids.

    ``first_doc``, ``last_doc``: only documents from and up to these; other blocks are not read, and of
    a block only the checkpoints that cover them are decoded. A block whose checksum is wrong raises an
    error. The frequency table goes through the driver: one row an id of the vocabulary.
    """
    known = spark.read.schema("id long, frequency long").parquet(f"{folder}/frequencies").collect()
    freq = np.zeros(max((r["id"] for r in known), default=0) + 1, np.int64)
    for r in known:
        freq[r["id"]] = r["frequency"]
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks").drop("shard")
    if first_doc is not None:
        blocks = blocks.filter(F.col("last_doc") >= first_doc)
    if last_doc is not None:
        blocks = blocks.filter(F.col("first_doc") <= last_doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, start, symbol = tables(freq)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["checksum"]:
                    raise ValueError(f"block at {row['start']} is damaged")
                docs, sizes = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["sizes"], "<i8")
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                a = 0 if first_doc is None else int(np.searchsorted(docs, first_doc))
                b = len(docs) if last_doc is None else int(np.searchsorted(docs, last_doc, "right"))
                place, ids = decode_block(row["payload"], f, start, symbol, int(bounds[a]), int(bounds[b]))
                ids = ids.astype("<u4")
                parts = [ids[x - place : y - place].tobytes() for x, y in zip(bounds[a:b].tolist(), bounds[a + 1 : b + 1].tolist(), strict=True)]
                last = pa.array([zlib.crc32(p) for p in parts], pa.int64()) if digest else pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(docs[a:b]), pa.array(row["start"] + bounds[a:b]), pa.array(sizes[a:b]), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    kind = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.BinaryType())
    return blocks.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens")] + [kind]))


def op5_token_blocks(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-blocks")
    write_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_blocks(spark, folder)


QUERIES = {"op5_token_blocks": op5_token_blocks}
