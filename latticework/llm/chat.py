r"""Conversations as training text: paths through reply trees, a reversible template, a loss mask.

Messages form trees by their parent. Ancestors are found by self-joins that double their reach, so a
path of n messages takes log2(n) rounds, and every root-to-leaf path becomes one conversation, ranked
within its tree by the sum of its messages' scores. A turn is written as

    ### role: text</turn>

with ``\`` doubled, ``</turn>`` as ``\l/turn>`` and ``### `` as ``\h## `` inside texts, and ``:`` as
``\c`` in roles as well; so neither marker occurs but where the template put it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("</turn>", "\\l/turn>").replace("### ", "\\h## ")
    return out.replace(":", "\\c") if role else out


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\l", "<").replace("\\h", "#").replace("\\c", ":") for p in parts)


def render(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans (start, end in code points) that carry loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role, True) + MIDDLE, escape(text)
        at += len(head)
        if role == learned:
            spans.append((at, at + len(body)))
        out += [head, body, CLOSE]
        at += len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` was given."""
    turns = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn[len(OPEN) :].partition(MIDDLE)
        turns.append((unescape(role), unescape(text)))
    return turns


def _joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join on tree_id and ``key``, where null tree_ids are one tree."""
    right = right.withColumnRenamed("tree_id", "other_tree").withColumnRenamed(key, "other_key")
    return left.join(right, F.col("tree_id").eqNullSafe(F.col("other_tree")) & (F.col(key) == F.col("other_key")), how).drop("other_tree", "other_key")


def paths(messages: DataFrame) -> DataFrame:
    """(tree_id, leaf, node, depth) for every message on the way from a root to each leaf; depth 0: the root.

    ``messages`` needs tree_id, node, parent (null at a root), node unique in its tree. A message whose
    parent is not there counts as a root; messages that lead back to themselves have no root and give
    no path. A null tree_id is a tree like any other.
    """
    nodes = messages.select("tree_id", "node", "parent")
    there = nodes.select("tree_id", F.col("node").alias("parent"), F.lit(True).alias("there"))
    up = _joined(nodes, there, "parent", "left").select("tree_id", "node", F.when(F.col("there"), F.col("parent")).alias("to"))
    up = materialize(up, "up")
    parents = up.filter("to is not null").select("tree_id", F.col("to").alias("node")).distinct()
    leaves = _joined(up, parents, "node", "left_anti").select("tree_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    total, reach, hop = up.count(), materialize(leaves, "paths"), 1
    while hop <= total:  # `to` is the ancestor `hop` steps up
        step = up.filter("to is not null")
        if step.isEmpty():
            break
        far = _joined(reach, step, "node").select("tree_id", "leaf", F.col("to").alias("node"), (F.col("above") + hop).alias("above"))
        reach = materialize(reach.unionByName(far), "paths")
        ahead = step.select("tree_id", F.col("node").alias("to"), F.col("to").alias("next"))
        up = materialize(_joined(step, ahead, "to").select("tree_id", "node", F.col("next").alias("to")), "up")
        hop *= 2
    length = Window.partitionBy("tree_id", "leaf")
    return reach.withColumn("depth", F.max("above").over(length) - F.col("above")).drop("above")


def _once(messages: DataFrame) -> DataFrame:
    """One row a node: of several, the least by parent, role, text and score."""
    rest = [c for c in ("parent", "role", "text", "score") if c in messages.columns]
    return messages.groupBy("tree_id", "node").agg(F.min(F.struct(*rest)).alias("row")).select("tree_id", "node", "row.*")


def format_conversations(messages: DataFrame, *, learned: str = LEARNED, unique: bool = False) -> DataFrame:
    """One row a root-to-leaf path: tree_id, leaf, branch_rank (1: best score), score, n_turns, formatted, loss_spans.

    ``messages``: tree_id, node, parent, role, text, and optionally score (null or missing: 0). Null
    role or text: empty. Ties of score go to the smaller leaf. A node that several rows have counts once,
    with the least of them; ``unique`` says that there is none. A message with a null node takes no part.
    Other columns are not read. An empty table gives an empty result.
    """
    messages = messages.filter("node is not null")
    if not unique:
        messages = materialize(_once(messages), "messages")
    if "score" not in messages.columns:
        messages = messages.withColumn("score", F.lit(0.0))
    full = messages.select("tree_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    turns = _joined(paths(messages), full, "node")
    turn = F.struct("depth", "role", "text")
    gathered = turns.groupBy("tree_id", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sum("score").alias("score"), F.count("*").alias("n_turns"))
    ranked = gathered.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf")).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in row], learned) for row in batch.column("turns").to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in done]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tree_id", "leaf", "branch_rank", "score", "n_turns")), pa.array([f for f, _ in done], pa.string()), pa.array(spans, kind)], ["tree_id", "leaf", "branch_rank", "score", "n_turns", "formatted", "loss_spans"])

    id_type, leaf_type = ranked.schema["tree_id"].dataType.simpleString(), ranked.schema["leaf"].dataType.simpleString()
    return ranked.mapInArrow(run, f"tree_id {id_type}, leaf {leaf_type}, branch_rank long, score double, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests taken from the formatted texts and their loss spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse(text)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), said, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("tree_id"), *arrays], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["tree_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """Each conversation is a tree without branches: a turn answers the one before it."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    messages = rows.select(F.col("conv_id").alias("tree_id"), node.alias("node"), "role", "text")
    messages = messages.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    return read_back(format_conversations(messages, unique=True))


QUERIES = {"op3_chat_format": op3_chat_format}
ORACLES = {
    "op3_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\l/turn>'), '### ', '\h## '), ':', '\c') AS er,
    replace(replace(replace(text, '\', '\\'), '</turn>', '\l/turn>'), '### ', '\h## ') AS et FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || er || ': ' || et || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
}
