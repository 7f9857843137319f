"""Health of a metric's sources, and lag of a queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A fall in the number of values of less than this share is healthy (fixed value).
MOST_LOST = 0.3


def distinct_values(points: DataFrame, metric: str, tag: str, start: int, stop: int) -> DataFrame:
    rows = points.where((F.col("metric") == metric) & (F.col("ts") >= start) & (F.col("ts") < stop))
    return rows.agg(F.countDistinct(F.col("tags")[tag]).alias("n_values"))


def health_check(points: DataFrame, metric: str, tag: str, now: int, interval: int, fixed: dict[str, str] | None = None) -> DataFrame:
    """``n_before, n_after, healthy`` of the windows [now - 3i, now - 2i) and [now - 2i, now - i), in one pass.

    healthy is null if the first window has no value.
    """
    a, b, c = now - 3 * interval, now - 2 * interval, now - interval
    rows = points.where((F.col("metric") == metric) & (F.col("ts") >= a) & (F.col("ts") < c))
    for k, v in (fixed or {}).items():
        rows = rows.where(F.col("tags")[k] == v)
    value = F.col("tags")[tag]
    n = rows.agg(F.countDistinct(F.when(F.col("ts") < b, value)).alias("n_before"), F.countDistinct(F.when(F.col("ts") >= b, value)).alias("n_after"))
    lost = F.try_divide(F.col("n_before") - F.col("n_after"), F.col("n_before"))
    return n.withColumn("healthy", lost < MOST_LOST)


def queue_lag(samples: DataFrame) -> DataFrame:
    """Newest sample of each partition: ``topic, partition_id, latest, consumed, lag`` (all of it before the first load)."""
    order = F.struct("sample_ms", "latest", F.coalesce("consumed", F.lit(-1)))
    last = samples.groupBy("topic", "partition_id").agg(F.max_by(F.struct("latest", "consumed"), order).alias("s"))
    return last.select("topic", "partition_id", "s.latest", "s.consumed", (F.col("s.latest") - F.coalesce("s.consumed", F.lit(0))).alias("lag"))


def lag_summary(lag: DataFrame) -> DataFrame:
    return lag.groupBy("topic").agg(F.sum("lag").alias("total_lag"), F.max("lag").alias("most_lag"))
