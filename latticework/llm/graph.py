"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import discard, materialize


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The links as a table; their number and order-free checksum, taken while they are written."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("checksum")), "links")
    return out, (seen.get["n"], seen.get["checksum"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that occurs in ``edges`` (a, b); component is its least node.

    Links move towards the least neighbour until every component is one star, in about log(diameter)
    rounds. Minima are combined before the shuffle and the joins carry two ids a row, so a node with
    very many links is split by the adaptive skew join. Self-links and repeats do no harm.
    """
    edges, seen = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        last = edges
        edges, now = _written(small)
        discard(last)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
