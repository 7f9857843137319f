"""Irregular readings onto the regular grid of a metric's intended interval.

Consecutive readings of a source form pairs.  For a cumulative counter a pair is
an increment (a reset starts again from zero) that is distributed over the grid
cells it spans in proportion to the overlap; for other metrics a cell keeps its
mean, and cells without a reading are interpolated.  Cells between the periods of two
consecutive readings hold no reading: they are the uncovered ones, marked in the
result.  Which metrics are counters the readings themselves tell.

Scale.  Pairs are found inside chunks of a source (a window over (source, chunk)),
and between chunks from the few first and last readings of the chunks only, so a
source with a third of all rows is spread over as many tasks as it has chunks.  The
pairs are written once to the shared folder; telling counters and filling the grid
read the columns they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import readings, series_key
from tidemark.session import written


def source_readings(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """``metric, series_key, step_s, ts, value, write_ms, point_id`` of metrics with a positive step."""
    steps = catalog.where(F.col("step_s") > 0).groupBy("metric").agg(F.max("step_s").alias("step_s"))
    return (
        readings(points.select("point_id", "metric", "tags", "ts", "int_value", "float_value", "write_ms"))
        .join(steps, "metric")
        .select("metric", series_key().alias("series_key"), "step_s", "ts", "value", "write_ms", "point_id")
    )


def consecutive_pairs(rows: DataFrame, *, chunk_steps: int = 4096) -> DataFrame:
    """Pairs of consecutive readings: ``series_key, step_s, t0, v0, t1, v1``; t0 and v0 null for a source's first.

    Of several deliveries of one (source, ts) the last written counts (write_ms,
    null first, then point_id).
    """
    chunk = F.floor(F.col("ts") / (F.col("step_s").cast("long") * chunk_steps))
    inner = Window.partitionBy("series_key", "chunk").orderBy("ts", F.col("write_ms").asc_nulls_first(), "point_id")
    base = (
        rows.select("series_key", "step_s", "ts", "value", "write_ms", "point_id", chunk.alias("chunk"))
        .withColumn("next_ts", F.lead("ts").over(inner))
        .where(F.col("next_ts").isNull() | (F.col("next_ts") != F.col("ts")))
        .withColumn("t0", F.lag("ts").over(inner))
        .withColumn("v0", F.lag("value").over(inner))
        .select("series_key", "step_s", "t0", "v0", F.col("ts").alias("t1"), F.col("value").alias("v1"), "next_ts")
    )
    inside = base.where(F.col("t0").isNotNull()).drop("next_ts")
    outer = Window.partitionBy("series_key").orderBy("t1")
    edges = (
        base.where(F.col("t0").isNull() | F.col("next_ts").isNull())
        .withColumn("first", F.col("t0").isNull())
        .withColumn("t0", F.lag("t1").over(outer))
        .withColumn("v0", F.lag("v1").over(outer))
        .where("first")
        .select("series_key", "step_s", "t0", "v0", "t1", "v1")
    )
    return inside.unionByName(edges)


def _cell(ts: Column) -> Column:
    return F.floor(ts / F.col("step_s")).cast("long")


def covered_cells(pairs: DataFrame) -> DataFrame:
    """Periods with readings: ``series_key, step_s, ts, n_readings, mean_value, last_value``."""
    return (
        pairs.withColumn("ts", (_cell(F.col("t1")) * F.col("step_s")).cast("int"))
        .groupBy("series_key", "step_s", "ts")
        .agg(
            F.count("*").alias("n_readings"),
            F.avg("v1").alias("mean_value"),
            F.max_by("v1", "t1").alias("last_value"),
        )
    )


def _metric(key: str = "series_key") -> Column:
    return F.substring_index(key, "{", 1)


def counter_metrics(pairs: DataFrame, *, most_falls: float = 0.05, least_rises: float = 0.5) -> DataFrame:
    """Metrics whose readings hardly ever fall and mostly rise: ``metric``, at most one row for each of the catalogue."""
    return (
        pairs.where(F.col("t0").isNotNull())
        .groupBy(_metric().alias("metric"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("v1") < F.col("v0")).alias("falls"), F.count_if(F.col("v1") > F.col("v0")).alias("rises"))
        .where((F.col("falls") <= most_falls * F.col("n")) & (F.col("rises") >= least_rises * F.col("n")))
        .select("metric")
    )


def increments(pairs: DataFrame) -> DataFrame:
    """Counter increments per grid cell: ``series_key, step_s, ts, increment, resets, n_readings``.

    A pair with a lower second value is a reset: its increment is the second value
    alone.  The increment of a pair is spread over [t0, t1) by overlap; zero-length
    pairs do not occur, as each (source, ts) counts once.  Cells from a source's first
    to its last reading have a row; one without a reading is uncovered (``n_readings``
    0): its share is an assumption.  A source of one reading has no increment (null).
    """
    step = F.col("step_s")
    pair = F.col("t0").isNotNull()
    grown = F.when(F.col("v1") >= F.col("v0"), F.col("v1") - F.col("v0")).otherwise(F.col("v1"))
    cells = F.when(pair, F.sequence(_cell(F.col("t0")), _cell(F.col("t1")))).otherwise(F.array(_cell(F.col("t1"))))
    overlap = F.least(F.col("t1").cast("long"), (F.col("k") + 1) * step) - F.greatest(F.col("t0").cast("long"), F.col("k") * step)
    reset = pair & (F.col("v1") < F.col("v0")) & (F.col("k") == _cell(F.col("t1") - 1))
    return (
        pairs.withColumn("k", F.explode(cells))
        .groupBy("series_key", "step_s", "k")
        .agg(
            F.sum(F.when(pair, grown * overlap / (F.col("t1") - F.col("t0")))).alias("increment"),
            F.count_if(reset).alias("resets"),
            F.count_if(F.col("k") == _cell(F.col("t1"))).alias("n_readings"),
        )
        .select("series_key", "step_s", (F.col("k") * step).cast("int").alias("ts"), "increment", "resets", "n_readings")
    )


def regular_grid(points: DataFrame, catalog: DataFrame, *, chunk_steps: int = 4096) -> DataFrame:
    """One row per source and period from its first to its last reading.

    ``series_key, ts, n_readings, value, filled, counter``.  Gauges: the mean of the
    period's readings, and in periods without one the value interpolated between the
    readings around them, at the period's start.  Counters: the increment in the
    period, resets taken into account, never interpolated over a reset.  Periods
    without a reading are marked by ``filled``.  Empty input gives an empty result.
    """
    pairs = written(consecutive_pairs(source_readings(points, catalog), chunk_steps=chunk_steps))
    marked = pairs.join(counter_metrics(pairs).select("metric", F.lit(True).alias("counter")), _metric() == F.col("metric"), "left").drop("metric")
    of_counters = increments(marked.where("counter")).select("series_key", "ts", "n_readings", F.col("increment").alias("value"), (F.col("n_readings") == 0).alias("filled"), F.lit(True).alias("counter"))
    gauges = marked.where("counter is null")
    k0, k1 = _cell(F.col("t0")), _cell(F.col("t1"))
    at = F.col("k") * F.col("step_s")
    holes = (
        gauges.where(F.col("t0").isNotNull() & (k1 - k0 > 1))
        .withColumn("k", F.explode(F.sequence(k0 + 1, k1 - 1)))
        .select(
            "series_key", at.cast("int").alias("ts"), F.lit(0).cast("long").alias("n_readings"),
            (F.col("v0") + (F.col("v1") - F.col("v0")) * (at - F.col("t0")) / (F.col("t1") - F.col("t0"))).alias("value"),
            F.lit(True).alias("filled"), F.lit(False).alias("counter"),
        )
    )
    held = covered_cells(gauges).select("series_key", "ts", "n_readings", F.col("mean_value").alias("value"), F.lit(False).alias("filled"), F.lit(False).alias("counter"))
    return held.unionByName(holes).unionByName(of_counters)
