"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed over the cells of all margins (source, language, topic). A cell's weight is at
first its tokens; margin by margin, the weights of each value's cells are multiplied by the factor that
gives the value its target share. Sums over a value's cells are combined
before they are shuffled, so a value that a third of all rows have holds up no task, and nothing but a
few totals reaches the driver.

A document's probability is ``fraction`` times its cell's raked over its actual tokens. The fraction is
the wanted one or, if that would ask a cell for more tokens than it has, the largest at which no cell is
asked for more: so the expected sample has the target shares. A hash of its doc_id decides over a
document, so the sample is the same however often a task runs.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .storage import discard, materialize

EXPONENT, FRACTION = 0.5, 0.6
#: rounds at most, and the relative change of a factor of the first margins at which they end
ROUNDS, TOLERANCE = 16, 1e-8
#: a margin's share may be off its target by this part of the sample
OFF = 0.01
MARGINS = ("source", "lang", "topic")
#: a plain topic where the table has none: short texts, texts of many lines, prose
TOPIC = "CASE WHEN length(text) < 800 THEN 'short' WHEN 200 * (length(text) - length(replace(text, chr(10), ''))) > length(text) THEN 'lines' ELSE 'prose' END"
#: an estimate of a text's tokens where the table has none
TOKENS = "(length(text) + 3) // 4"


class InfeasibleTargets(ValueError):
    """No sample has all the target shares."""


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def tempered(cells: DataFrame, margin: str, exponent: float) -> DataFrame:
    """(margin, share): target shares in proportion to the values' tokens to the power ``exponent``."""
    return cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(exponent)).alias("share"))


def _values(cells: DataFrame, margin: str, targets: DataFrame, total: float) -> DataFrame:
    """(margin, share): a value without a target keeps its share of the tokens; shares sum to 1 over the values that occur."""
    own = cells.groupBy(margin).agg((F.sum("tokens") / F.lit(total or 1.0)).alias("own"))
    aims = own.join(targets.select(margin, F.col("share").cast("double")), margin, "left").select(margin, F.coalesce("share", "own").alias("share"))
    aims = materialize(aims, "shares", clean=False)
    norm = aims.agg(F.sum("share")).head()[0] or 1.0
    return aims.select(margin, (F.col("share") / F.lit(float(norm))).alias("share"))


def rake(cells: DataFrame, margins: tuple[str, ...], targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``cells`` (margins, tokens) with weight: raked tokens, in the same total; and the values of each margin with their shares.

    A value without a target share keeps its share of the tokens; shares are scaled to sum to 1 over
    the values that occur. The cells are as many as combinations occur; none goes to the driver.
    """
    total = float(cells.agg(F.sum("tokens")).head()[0] or 0.0)
    values = {m: _values(cells, m, targets[m], total) for m in margins}
    out = cells
    for m in margins:
        out = out.join(values[m].withColumnRenamed("share", f"share_{m}"), m)
    raked = materialize(out.withColumn("weight", F.col("tokens").cast("double")), "raked")
    columns = raked.columns
    for _ in range(rounds):  # one plan and one table a round: each plan costs the driver memory
        out = raked
        for m in margins:
            sums = out.groupBy(m).agg(F.sum("weight").alias("_sum"), F.max(f"share_{m}").alias("_share"))
            new = F.when(F.col("_sum") > 0, F.col("_share") * F.lit(total) / F.col("_sum")).otherwise(F.lit(1.0))
            out = out.join(sums.select(m, new.alias(f"factor_{m}")), m).withColumn("weight", F.col("weight") * F.col(f"factor_{m}"))
        # the change is taken while the weights are written; the last margin's follows from the others'
        changes = [F.abs(F.col(f"factor_{m}") - 1) for m in margins[:-1]]
        seen, last = Observation(), raked
        raked = materialize(out.observe(seen, F.max(F.greatest(F.lit(0.0), F.lit(0.0), *changes)).alias("change")).select(*columns), "raked")
        discard(last)
        if (seen.get["change"] or 0.0) <= tolerance:
            break
    return raked.select(*margins, "tokens", "weight"), values


def _cells(docs: DataFrame, margins: dict[str, Column], tokens: Column, exponent: float, targets: dict[str, DataFrame] | None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    marked = docs
    for m, value in margins.items():
        marked = marked.withColumn(f"mix_{m}", F.coalesce(value.cast("string"), F.lit("(none)")))
    marked = marked.withColumn("mix_tokens", F.coalesce(tokens.cast("long"), F.lit(0).cast("long")))
    keys = [f"mix_{m}" for m in margins]
    cells = materialize(marked.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens")), "cells", clean=False)
    aims = {f"mix_{m}": targets[m].withColumnRenamed(m, f"mix_{m}") if targets and m in targets else tempered(cells, f"mix_{m}", exponent) for m in margins}
    return marked, cells, aims


def _sampled(cells: DataFrame, keys: tuple[str, ...], aims: dict[str, DataFrame], fraction: float, least: float) -> tuple[DataFrame, DataFrame]:
    """Cells with mix_probability; and (margin, value, tokens, target, reached) of every value."""
    raked, shares = rake(cells, keys, aims)
    top = raked.filter("tokens > 0").agg(F.max(F.col("weight") / F.col("tokens"))).head()[0]
    part = min(fraction, max(least, 1.0 / top)) if top else fraction
    chance = F.least(F.lit(1.0), F.when(F.col("tokens") > 0, F.lit(part) * F.col("weight") / F.col("tokens")).otherwise(F.lit(part)))
    # a table on disk: its known size lets the optimiser broadcast it while it is small, and join by sorting beyond
    out = materialize(raked.select(*keys, "tokens", chance.alias("mix_probability")), "sampled", clean=False)
    expected = out.agg(F.sum(F.col("tokens") * F.col("mix_probability"))).head()[0] or 1.0
    told = None
    for m in keys:
        sums = out.groupBy(m).agg(F.sum("tokens").alias("tokens"), (F.sum(F.col("tokens") * F.col("mix_probability")) / F.lit(expected)).alias("reached"))
        sums = sums.join(shares[m], m).select(F.lit(m).alias("margin"), F.col(m).alias("value"), "tokens", F.col("share").alias("target"), "reached")
        told = sums if told is None else told.unionByName(sums)
    return out, told


def calibrated(docs: DataFrame, *, margins: dict[str, Column], tokens: Column, fraction: float = FRACTION, least: float = 0.0, exponent: float = EXPONENT, targets: dict[str, DataFrame] | None = None, strict: bool = True) -> DataFrame:
    """``docs`` with the columns mix_<margin>, mix_tokens, mix_probability and mix_kept.

    The sample has ``fraction`` of the tokens, or as many as leave every probability at 1 or less; not
    under ``least``, at which probabilities are cut at 1 and targets missed. If a margin's expected share
    misses its target by more than ``OFF`` of the sample (values that exclude each other, or ``least``),
    that is an error, or with ``strict`` false a warning; ``margins_reached`` has all shares.

    Null values of a margin are the value ``(none)``; null tokens count 0, and a cell without tokens has
    the sample's fraction as its probability. A null doc_id is kept if the probability is 1 only. Repeated
    rows fare alike. An empty table gives an empty result. ``targets``: (margin, share) tables; by default
    shares tempered with ``exponent``. Columns of the names above are replaced, all others stay.
    """
    marked, cells, aims = _cells(docs, margins, tokens, exponent, targets)
    keys = tuple(f"mix_{m}" for m in margins)
    raked, told = _sampled(cells, keys, aims, fraction, least)
    off = told.agg(F.max(F.abs(F.col("reached") - F.col("target")))).head()[0]
    if off is not None and off > OFF:
        if strict:
            raise InfeasibleTargets(f"a margin's share misses its target by {off:.4f}")
        warnings.warn(f"a margin's share misses its target by {off:.4f}", stacklevel=2)
    out = marked.drop("mix_probability", "mix_kept").join(raked.drop("tokens"), list(keys))
    return out.withColumn("mix_kept", F.coalesce(uniform(F.col("doc_id")) < F.col("mix_probability"), F.col("mix_probability") >= 1))


def margins_reached(docs: DataFrame, *, margins: dict[str, Column], tokens: Column, fraction: float = FRACTION, least: float = 0.0, exponent: float = EXPONENT, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """What ``calibrated`` makes of each value: margin, value, tokens, target and expected share of the sample, feasible (to ``OFF``)."""
    _, cells, aims = _cells(docs, margins, tokens, exponent, targets)
    _, told = _sampled(cells, tuple(f"mix_{m}" for m in margins), aims, fraction, least)
    return told.withColumn("margin", F.expr("substring(margin, 5)")).withColumn("feasible", F.abs(F.col("reached") - F.col("target")) <= OFF)


def document_margins(docs: DataFrame) -> dict:
    """The columns source and lang, the columns topic and n_tokens or, without them, a topic taken from the text and an estimate."""
    topic = F.col("topic") if "topic" in docs.columns else F.expr(TOPIC)
    tokens = F.col("n_tokens") if "n_tokens" in docs.columns else F.expr(TOKENS.replace("//", "div"))
    return {"margins": {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}, "tokens": tokens}


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = calibrated(docs, **document_margins(docs), strict=False)
    return out.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"))


def _oracle() -> str:
    """The same raking, cell by cell, for all rounds."""
    parts = [
        f"""d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce({TOPIC}, '(none)') AS topic, coalesce({TOKENS}, 0) AS tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        *(f"t_{m} AS (SELECT {m}, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) OVER () AS share FROM cells GROUP BY {m})" for m in MARGINS),
        "w0 AS MATERIALIZED (SELECT cells.*, tokens AS weight, t_source.share AS s_source, t_lang.share AS s_lang, t_topic.share AS s_topic, sum(tokens) OVER () AS total FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))",
    ]
    n = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {m}) > 0 THEN weight * s_{m} * total / sum(weight) OVER (PARTITION BY {m}) ELSE weight END AS weight) FROM w{n})")
            n += 1
    parts.append(f"f AS (SELECT coalesce(least({FRACTION}::DOUBLE, 1 / max(weight / tokens) FILTER (tokens > 0)), {FRACTION}) AS fraction FROM w{n})")
    parts.append(f"p AS (SELECT source, lang, topic, least(1.0, CASE WHEN tokens > 0 THEN fraction * weight / tokens ELSE fraction END) AS p FROM w{n}, f)")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(p, 6) AS probability,
  (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496) < p AS kept
FROM d JOIN p USING (source, lang, topic)"""


QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": _oracle()}
