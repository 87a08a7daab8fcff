"""Running moments of a stream: windowed sums that give means, variances and covariances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(events: DataFrame, time: str, value: str, keys: list[str], *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, keys, n, mean, variance) for a streaming or a static table; rows later than ``late`` are dropped."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    x = F.col(value).cast("double")
    out = rows.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "mean", "variance")
