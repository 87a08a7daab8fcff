"""Benchmark reports: scan of result files, classification, comparison with a baseline, history and trends."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels import EPSILON

BENCHMARK = "group_id string, function_id string, full_id string, value_str string, title string"
ESTIMATE = "struct<point_estimate: double>"
ESTIMATES = f"mean {ESTIMATE}, median {ESTIMATE}, std_dev {ESTIMATE}"

# The domains that a group's name begins with, and the groups of competitors with their backends.
DOMAINS = ("svd", "qr", "triangular", "matrix_functions", "lu", "cholesky", "eigen", "vector", "sparse", "schur", "sylvester", "optimization")
RIVALS = {
    "svd_competitor_faer_direct": "faer_direct",
    "qr_competitor_faer_direct": "faer_direct",
    "svd_competitor_ndarray_linalg": "ndarray_linalg",
    "qr_competitor_ndarray_linalg": "ndarray_linalg",
    "vector_competitor_ndarray": "ndarray_baseline",
    "sparse_competitor_ndarray": "ndarray_baseline",
    "optimization_competitor_manual": "manual_baseline",
}
CSV = ("domain", "backend", "competitor", "operation", "size", "shape", "rows", "cols", "dtype", "time_ns", "median_ns", "std_dev_ns", "throughput", "correctness", "full_id")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each ``new/benchmark.json`` under ``folder`` with an ``estimates.json`` beside it; a file that is no JSON is an error."""

    def read(name: str, schema: str) -> DataFrame:
        reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name)
        files = reader.option("multiLine", True).option("mode", "FAILFAST").json(folder)
        place = F.regexp_replace(F.input_file_name(), "/[^/]*$", "")
        return files.withColumn("place", place).filter(F.col("place").endswith("/new"))

    both = read("benchmark.json", BENCHMARK).join(read("estimates.json", ESTIMATES), "place").dropDuplicates(["place"])
    return both.select("group_id", "function_id", "full_id", "value_str", F.col("mean.point_estimate").alias("mean_ns"), F.col("median.point_estimate").alias("median_ns"), F.col("std_dev.point_estimate").alias("std_dev_ns"))


def shape_of(value: Column) -> tuple[Column, Column, Column]:
    """Shape, rows and columns of ``<shape>-<rows>x<columns>``: what is before the first ``-`` and around the first ``x`` behind it.

    Without a ``-`` the shape is ``unknown``; a number that is none is 0.
    """
    value = F.coalesce(value, F.lit(""))
    dash = F.instr(value, "-")
    sizes = F.when(dash > 0, F.substring(value, dash + 1, F.length(value)))
    cross = F.instr(sizes, "x")

    def number(text: Column) -> Column:
        digits = F.when((cross > 0) & text.rlike(r"^\+?[0-9]+$"), F.regexp_replace(text, r"^\+", ""))
        return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))

    shape = F.when(dash > 0, F.substring(value, F.lit(1), dash - 1)).otherwise("unknown")
    return shape, number(F.substring(sizes, F.lit(1), cross - 1)), number(F.substring(sizes, cross + 1, F.length(sizes)))


def own_groups(project: str, backend: str = "ndarray") -> dict[str, str]:
    """The groups ``<domain>_<project>_<backend>`` of a project's own benchmarks."""
    return {f"{d}_{project}_{backend}": backend for d in DOMAINS}


def classify(entries: DataFrame, own: dict[str, str], rivals: dict[str, str] | None = None) -> DataFrame:
    """Entries with domain, operation, backend, competitor, shape, rows, cols, size and more, sorted by full_id.

    ``own``, ``rivals``: the backend of each group of the project and of its competitors. The competitor of
    an own group is ``none``; a group in neither is ``unknown``, so it is never compared as an own one.
    """
    domain = F.lit("unknown")
    for name in reversed(DOMAINS):
        domain = F.when(F.col("group_id").startswith(f"{name}_"), name).otherwise(domain)
    backend, rival = F.lit("unknown"), F.lit("unknown")
    for group, name in (RIVALS if rivals is None else rivals).items():
        backend, rival = (F.when(F.col("group_id") == group, name).otherwise(x) for x in (backend, rival))
    for group, name in own.items():
        backend, rival = (F.when(F.col("group_id") == group, x).otherwise(y) for x, y in ((name, backend), ("none", rival)))
    shape, rows, cols = shape_of(F.col("value_str"))
    out = entries.withColumns({"domain": domain, "operation": F.col("function_id"), "backend": backend, "competitor": rival, "shape": shape, "rows": rows, "cols": cols})
    out = out.withColumns({"size": F.least("rows", "cols"), "dtype": F.lit("f64"), "throughput": F.lit(None).cast("string"), "correctness": F.lit("passed")})
    return out.orderBy("full_id")


@dataclass(frozen=True)
class Policy:
    warn_pct: float = 5.0
    fail_pct: float = 10.0
    min_regression_ns: float = 25_000.0
    min_baseline_ns: float = 0.0

    @classmethod
    def from_environment(cls) -> Policy:
        """From BENCH_WARN_PCT, BENCH_FAIL_PCT, BENCH_MIN_REGRESSION_NS, BENCH_MIN_BASELINE_NS; a value that is no finite number from 0 on counts as not set."""

        def read(name: str) -> float:
            try:
                value = float(os.environ.get(f"BENCH_{name.upper()}", ""))
            except ValueError:
                return getattr(cls, name)
            return value if math.isfinite(value) and value >= 0 else getattr(cls, name)

        return cls(**{name: read(name) for name in ("warn_pct", "fail_pct", "min_regression_ns", "min_baseline_ns")})


def compare(current: DataFrame, baseline: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Own entries that the baseline has too: current_ns, baseline_ns, delta_percent and status.

    SKIP_NOISE_FLOOR: the baseline is below ``min_baseline_ns``, nothing is compared. FAIL, WARN: slower by
    more than the percentage and by more than ``min_regression_ns``. Else OK. Of a baseline that repeats a
    full_id, its largest median counts.
    """
    own = current.filter("competitor = 'none'").select("full_id", F.col("median_ns").alias("current_ns"))
    known = baseline.groupBy("full_id").agg(F.max("median_ns").alias("baseline_ns"))
    both = own.join(known, "full_id")
    gap = F.col("current_ns") - F.col("baseline_ns")
    skip = F.col("baseline_ns") < policy.min_baseline_ns
    delta = F.when(F.col("baseline_ns") > EPSILON, gap / F.col("baseline_ns") * 100.0).otherwise(0.0)
    slower = gap > policy.min_regression_ns
    status = F.when(skip, "SKIP_NOISE_FLOOR").when(slower & (delta > policy.fail_pct), "FAIL").when(slower & (delta > policy.warn_pct), "WARN").otherwise("OK")
    return both.withColumn("delta_percent", F.when(~skip, delta)).withColumn("status", status)


def regression_counts(compared: DataFrame) -> DataFrame:
    """One row: warnings, failures and compared cases (skipped ones are not compared)."""
    count = lambda c: F.count_if(c)
    return compared.agg(count(F.col("status") == "WARN").alias("warnings"), count(F.col("status") == "FAIL").alias("failures"), count(F.col("status") != "SKIP_NOISE_FLOOR").alias("compared"))


def exit_code(compared: DataFrame | None) -> int:
    """2 without a baseline, 3 with regressions, else 0."""
    if compared is None:
        return 2
    return 3 if not compared.filter("status = 'FAIL'").isEmpty() else 0


def geometric_mean(value: Column) -> Column:
    """Over finite positive values; 0 if there is none. An aggregate."""
    sound = (value > 0) & (value < float("inf"))
    return F.coalesce(F.exp(F.avg(F.when(sound, F.ln(value)))), F.lit(0.0))


def run_record(entries: DataFrame, run_id: str, generated_at_unix: int, branch: str = "local", git_sha: str = "unknown") -> DataFrame:
    """One row a run: the medians of its own entries by full_id, their number and their geometric mean.

    An entry that repeats a full_id counts once, with its largest median.
    """
    own = entries.filter("competitor = 'none'").groupBy("full_id").agg(F.max("median_ns").alias("median_ns"))
    record = own.agg(F.count("*").alias("case_count"), geometric_mean(F.col("median_ns")).alias("geometric_mean_ns"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("full_id", "median_ns")))).alias("medians"))
    return record.select(F.lit(run_id).alias("run_id"), F.lit(branch).alias("branch"), F.lit(git_sha).alias("git_sha"), F.lit(generated_at_unix).cast("long").alias("generated_at_unix"), "case_count", "geometric_mean_ns", "medians")


def upsert(history: DataFrame, run: DataFrame, keep: int = 20) -> DataFrame:
    """The history with a run put in by run_id, its latest ``keep`` runs, the oldest first."""
    rest = history.join(run.select("run_id"), "run_id", "left_anti").select(*run.columns)
    latest = rest.unionByName(run).orderBy(F.desc("generated_at_unix"), F.desc("run_id")).limit(keep)
    return latest.orderBy("generated_at_unix", "run_id")


def _change(now: Column, ref: Column) -> Column:
    """Percent, null without a reference or where that is 0."""
    return F.when(ref > EPSILON, (now - ref) / ref * 100.0)


def run_trend(history: DataFrame) -> DataFrame:
    """Each run with its geometric mean's change against the previous and the first run; the history is bounded by its ``keep``."""
    over = Window.orderBy("generated_at_unix", "run_id")
    mean = F.col("geometric_mean_ns")
    return history.select("run_id", "branch", F.substring("git_sha", 1, 12).alias("git_sha"), "generated_at_unix", "case_count", "geometric_mean_ns", _change(mean, F.lag(mean).over(over)).alias("vs_previous"), _change(mean, F.first(mean).over(over)).alias("vs_first"))


def case_snapshot(history: DataFrame) -> DataFrame:
    """Each benchmark of the latest run: its median, that of the run before, the change, and the range over all runs."""
    over = Window.orderBy(F.desc("generated_at_unix"), F.desc("run_id"))
    cases = history.withColumn("age", F.row_number().over(over)).select("age", F.explode("medians").alias("benchmark", "median_ns"))
    sums = cases.groupBy("benchmark").agg(F.max(F.when(F.col("age") == 1, F.col("median_ns"))).alias("latest_ns"), F.max(F.when(F.col("age") == 2, F.col("median_ns"))).alias("previous_ns"), F.min("median_ns").alias("least_ns"), F.max("median_ns").alias("most_ns"))
    return sums.filter("latest_ns is not null").select("benchmark", "latest_ns", "previous_ns", _change(F.col("latest_ns"), F.col("previous_ns")).alias("vs_previous"), "least_ns", "most_ns")


def trends(medians: DataFrame) -> DataFrame:
    """For (benchmark, at, median_ns): change against the previous and the first run, and the range; null where the reference is 0."""
    over = Window.partitionBy("benchmark").orderBy("at")
    whole = Window.partitionBy("benchmark")
    now = F.col("median_ns")
    return medians.select("*", _change(now, F.lag("median_ns").over(over)).alias("vs_previous"), _change(now, F.first("median_ns").over(over)).alias("vs_first"), F.min("median_ns").over(whole).alias("least_ns"), F.max("median_ns").over(whole).alias("most_ns"))


def capabilities(spark: SparkSession) -> DataFrame:
    """(tier, domain, baseline_kernels, provider_path, notes): where each domain's operators run here.

    ``native``: in the JVM, as column expressions or aggregates; ``fallback``: numpy over Arrow batches.
    """
    rows = [
        ("tier_a", "svd", True, "fallback", "operators/cells.py, operators/tall.py"),
        ("tier_a", "qr", True, "fallback", "operators/cells.py, operators/tall.py"),
        ("tier_a", "lu", True, "fallback", "operators/cells.py"),
        ("tier_a", "cholesky", True, "fallback", "operators/cells.py"),
        ("tier_a", "eigen", True, "fallback", "operators/cells.py"),
        ("tier_a", "schur", True, "fallback", "operators/cells.py"),
        ("tier_a", "triangular_solve", True, "fallback", "operators/cells.py"),
        ("tier_a", "vector_primitives", True, "native", "functions/vectors.py; all pairs: operators/pairwise.py"),
        ("tier_b", "polar", True, "fallback", "operators/cells.py"),
        ("tier_b", "pca", True, "fallback", "operators/stats.py"),
        ("tier_b", "regression", True, "native", "operators/stats.py"),
        ("tier_b", "sylvester_lyapunov", True, "fallback", "operators/cells.py"),
        ("tier_b", "matrix_functions", True, "fallback", "operators/cells.py"),
        ("tier_b", "sparse", True, "native", "operators/sparse.py"),
        ("tier_b", "iterative", True, "native", "operators/iterative.py"),
        ("tier_b", "derivatives", True, "native", "operators/differentiation.py"),
        ("tier_b", "statistics", True, "native", "operators/stats.py"),
    ]
    return spark.createDataFrame(rows, "tier string, domain string, baseline_kernels boolean, provider_path string, notes string")


def capability_counts(table: DataFrame) -> DataFrame:
    """One row: the domains on either path."""
    return table.agg(F.count_if(F.col("provider_path") == "native").alias("native_provider_domains"), F.count_if(F.col("provider_path") == "fallback").alias("fallback_provider_domains"))


def _shown(df: DataFrame, digits: int, empty: str) -> list[Column]:
    number = lambda c: F.format_string(f"%.{digits}f", F.col(c))
    return [F.coalesce(number(c) if kind == "double" else F.col(c).cast("string"), F.lit(empty)) for c, kind in df.dtypes]


def summary_csv(entries: DataFrame) -> DataFrame:
    """Classified entries as the columns of the report's CSV file, in order, with three decimals; write it with a header."""
    named = entries.withColumn("time_ns", F.col("mean_ns")).select(*CSV).orderBy("full_id")
    return named.select(*(c.alias(n) for c, n in zip(_shown(named, 3, ""), CSV, strict=True)))


def markdown_lines(df: DataFrame, digits: int = 3) -> DataFrame:
    """(value): the rows of a report as lines of a table, all of them, in the order of ``df``; ``write.text`` stores them under ``markdown_head``."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *_shown(df, digits, "n/a")), F.lit(" |")).alias("value"))


def markdown_head(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]


def markdown(df: DataFrame, digits: int = 3) -> str:
    """The whole table as text, fetched a partition at a time: a text on the driver is as long as the report."""
    return "\n".join([*markdown_head(df), *(r["value"] for r in markdown_lines(df, digits).toLocalIterator())])
