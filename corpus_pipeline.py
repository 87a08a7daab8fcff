"""A corpus from raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept, and all but the last return the columns of
``documents``; ``run`` writes every stage's result and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import language, mixing, near_dedup, packing, repeats
from latticework.llm.storage import discard, materialize

#: a document whose n-grams are known to its best language to a smaller share than this is no text in it
LEAST_KNOWN = 0.5
#: target shares are in proportion to the tokens to this power: near 1, so that a sample with most of the tokens can have them
MIX_EXPONENT = 0.95


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with the language found; the others go."""
    found = language.identify(docs, language.learned_of(docs))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_KNOWN))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id.

    Rows with a null doc_id can't be told apart by it and stay as they are.
    """
    kept = near_dedup.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out; a document of which nothing is left goes.

    Rows with a null doc_id stay as they are, and no passage counts as repeated because of them.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = repeats.remove_repeats(docs.filter("doc_id is not null"), carry=others)
    rest = cut.filter((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars")).alias("n_chars")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text").alias("text"), "n_chars": n_chars}
    named = rest.select(*(new[c] if c in new else F.col("carried")[c].alias(c) for c in docs.columns))
    return named.unionByName(docs.filter("doc_id is null"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest sample that has the target weights of source, language and topic.

    Documents of values above their target go with a probability, those of the value furthest below it
    all stay (README: the share kept and the margins reached). Null values of a margin are a value of
    their own. A row with a null doc_id stays only if its probability is 1. Repeated rows fare alike.
    """
    out = mixing.calibrated(docs, **mixing.document_margins(docs), fraction=1.0, exponent=MIX_EXPONENT, strict=False)
    return out.filter("mix_kept").select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]
#: the tokenizer and the suffix array have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
