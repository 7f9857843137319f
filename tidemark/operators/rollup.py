"""Roll-ups: stored partial aggregates at five minutes, one hour and one day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds of the stored resolutions (fixed values).
RESOLUTIONS = {"5m": 300, "hour": 3600, "day": 86400}
STRATEGIES = {"hour": ("5m", "hour"), "day": ("day",)}
PARTIALS = ("max", "min", "sum", "avg")


def roll_up(rows: DataFrame, resolution: str, keys: list[str] = ["metric", "tags_key"]) -> DataFrame:  # noqa: B006
    """max, min, sum and avg per series and bucket, 32-bit, at the bucket's start: ``keys, ts, value, resolution, agg``.

    One aggregation with map-side partials; the four results are unpivoted after it.
    """
    step = RESOLUTIONS[resolution]
    per = rows.withColumn("ts", (F.col("ts") - F.col("ts") % step).cast("int")).groupBy(*keys, "ts").agg(
        F.max("value").alias("max"), F.min("value").alias("min"), F.sum("value").alias("sum"), F.avg("value").alias("avg")
    )
    return _unpivot(per, keys, resolution)


def _unpivot(per: DataFrame, keys: list[str], resolution: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(a).alias("agg"), F.col(a).cast("float").alias("value")) for a in PARTIALS))
    return per.select(*keys, "ts", F.explode(each).alias("e")).select(*keys, "ts", "e.value", F.lit(resolution).alias("resolution"), "e.agg")


def day_from_hours(hours: DataFrame, keys: list[str] = ["metric", "tags_key"]) -> DataFrame:  # noqa: B006
    """Day roll-ups from hour roll-ups, each aggregate from its own partials (the average of averages is unweighted)."""
    step = RESOLUTIONS["day"]
    value = F.col("value").cast("double")
    combined = (
        F.when(F.col("agg") == "max", F.max(value)).when(F.col("agg") == "min", F.min(value)).when(F.col("agg") == "sum", F.sum(value)).otherwise(F.avg(value))
    )
    return (
        hours.where(F.col("resolution") == "hour")
        .withColumn("ts", (F.col("ts") - F.col("ts") % step).cast("int"))
        .groupBy(*keys, "ts", "agg")
        .agg(combined.cast("float").alias("value"))
        .select(*keys, "ts", "value", F.lit("day").alias("resolution"), "agg")
    )


def check_bounds(start: int, stop: int, strategy: str) -> None:
    """Bounds of a job must lie on its coarsest bucket."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    step = max(RESOLUTIONS[r] for r in STRATEGIES[strategy])
    if start >= stop or start % step or stop % step:
        raise ValueError(f"bounds must be ascending multiples of {step}")


def roll_up_job(source: DataFrame, start: int, stop: int, strategy: str, path: str | None = None, keys: list[str] = ["metric", "tags_key"]) -> DataFrame:  # noqa: B006
    """Roll-ups of [start, stop): ``hour`` from readings (5m and hour), ``day`` from hour roll-ups.

    With a path the result replaces the partitions (resolution, day) that it holds
    and nothing else, so that a repeated job changes nothing.
    """
    check_bounds(start, stop, strategy)
    rows = source.where((F.col("ts") >= start) & (F.col("ts") < stop))
    if strategy == "day":
        out = day_from_hours(rows, keys)
    else:
        out = None
        for resolution in STRATEGIES[strategy]:
            one = roll_up(rows, resolution, keys)
            out = one if out is None else out.unionByName(one)
    if path is not None:
        (
            out.withColumn("day", F.floor(F.col("ts") / 86400).cast("int"))
            .sortWithinPartitions(*keys, "ts")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("resolution", "day").parquet(path)
        )
    return out
