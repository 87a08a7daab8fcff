"""The registered queries over tables with nulls in every column, repeated rows, all-null rows and extra columns with clashing names."""

from pathlib import Path

import pytest

pytest.importorskip("latticework.llm.registry")

from pyspark.sql import functions as F  # noqa: E402

from latticework.llm import registry  # noqa: E402

SOURCE = Path("/root/testdata/sf0.001")
CLASHING = ("n", "rank", "score", "length", "tags", "key", "kept", "part", "size", "first", "ids", "start", "shard", "block", "place", "spans", "runs", "carried", "mix_tokens", "lang_pred", "bucket", "raw", "target", "query", "near", "turns", "leaf", "depth", "node", "parent", "full", "salt", "offset", "members", "copies", "factor", "share", "weight")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    if not SOURCE.exists():
        pytest.skip("no tables here")
    out = tmp_path_factory.mktemp("edges")
    for name in ("documents", "labels", "embeddings", "conversations"):
        rows = spark.read.parquet(f"{SOURCE}/{name}.parquet").limit(30)
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        full = rows.unionByName(rows.limit(2))
        for c, kind in kinds.items():
            full = full.unionByName(rows.limit(2).withColumn(c, F.lit(None).cast(kind)))
        full = full.unionByName(rows.limit(1).select(*(F.lit(None).cast(kind).alias(c) for c, kind in kinds.items())))
        full.withColumns({c: F.lit("x") for c in CLASHING if c not in kinds}).write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in ("op4_hamming_topk", "op9_graph_search")])
def test_query_takes_odd_rows(spark, folder, name):
    out = registry.queries()[name](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows, named = docs.count(), docs.filter("doc_id is not null").count()
    if name in ("op2_language_id", "op10_mixing"):
        assert len(out) == rows
    elif name in ("op1_near_dedup", "op5_token_blocks", "op7_repeats", "op8_quality_resampling"):
        assert len(out) == named
    elif name == "op6_packing":
        assert sum(r["offset"] == 0 for r in out) <= len(out) and sum(r["start"] == 0 for r in out) == rows
    else:
        talks = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id").distinct().count()
        assert len(out) == talks + 1


@pytest.mark.parametrize("name", ["op4_hamming_topk", "op9_graph_search"])
def test_search_takes_odd_rows(spark, folder, name):
    out = registry.queries()[name](spark, folder).collect()
    ids = {r[0] for r in spark.read.parquet(f"{folder}/embeddings.parquet").filter("vec_id is not null and embedding is not null").select("vec_id").collect()}
    assert out and {r["vec_id"] for r in out} <= ids and all(r["vec_id"] != r["query_id"] for r in out)
    assert len({(r["query_id"], r["rank"]) for r in out}) == len(out)
