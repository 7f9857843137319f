"""Streaming ingest: lines in, points and dead letters out, at least once with idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import lines as parsing
from tidemark.functions.times import Period, generation_ranges
from tidemark.operators import rollup
from tidemark.operators.scan import last_write
from tidemark.sinks.store import Sink

MOST_SPANS = 50  # ranges of days in one filter


def start(df: DataFrame, sink: Sink, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Run ``sink`` on each micro-batch; offsets are committed after it returns, a failed batch comes again."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_lines(parsed: DataFrame, points: Sink, dead: Sink | None, checkpoint: str, *, replies: Sink | None = None, clock=None, trigger: dict | None = None) -> StreamingQuery:
    """Valid points with a write time to ``points``, rejected lines with their error to ``dead``.

    ``write_seq`` keeps the order of a micro-batch, so that of two lines for one point the later one wins.
    ``replies`` gets ``OK N = batch`` for each ``commit N`` line, in their order (``seq``), after the points are written.
    """

    def both(df: DataFrame, number: int) -> None:
        now = clock() if clock else None
        write = F.lit(now).cast("long") if now is not None else F.unix_millis(F.current_timestamp())
        df = df.withColumn("write_seq", F.monotonically_increasing_id()).persist()
        try:
            points(parsing.valid_points(df, "write_seq").withColumn("write_ms", write), number)
            if dead is not None:
                dead(parsing.dead_letters(df), number)
            if replies is not None:
                commits = df.where((F.col("command") == "commit") & F.col("argument").isNotNull())
                replies(commits.select(F.col("write_seq").alias("seq"), F.format_string(f"OK %d = {number}", "argument").alias("line")), number)
        finally:
            df.unpersist()

    return start(parsed, both, checkpoint, trigger=trigger)


def rolling(points: DataFrame, path: str, checkpoint: str, *, resolution: str = "5m", store=None, config: list[Period] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Roll-ups of the days that a batch touches, computed again from the store and replaced.

    Late points are welcome: their day is rolled up anew.  ``store()`` reads the whole
    points table; of it the days touched are read, as ranges of ts that reach the scan
    (and as generations, with a ``config`` and a ``store`` that has them).
    """

    def sink(df: DataFrame, number: int) -> None:
        days = sorted(r.d for r in df.where("ts is not null").select(F.floor(F.col("ts") / 86400).alias("d")).distinct().collect())  # days of one micro-batch
        if not days:
            return
        spans: list[list[int]] = []
        for d in days:  # neighbouring days are one range
            if spans and spans[-1][1] == d:
                spans[-1][1] = d + 1
            else:
                spans.append([d, d + 1])
        if len(spans) > MOST_SPANS:  # very scattered days: their hull, and the days themselves by a semi-join
            hull = (F.col("ts") >= spans[0][0] * 86400) & (F.col("ts") < spans[-1][1] * 86400)
            rows = store().where(hull)
            touched = rows.join(df.select(F.floor(F.col("ts") / 86400).alias("d")).distinct(), F.floor(rows.ts / 86400) == F.col("d"), "left_semi")
        else:
            inside = F.lit(False)
            for a, b in spans:
                inside |= (F.col("ts") >= a * 86400) & (F.col("ts") < b * 86400)
            touched = store().where(inside)
        if config is not None:
            touched = touched.where(F.col("gen").isin(sorted({g for a, b in spans for _, _, g in generation_ranges(config, a * 86400, b * 86400)})))
        out = rollup.roll_up(last_write(touched, tie=None), resolution)
        (
            out.withColumn("day", F.floor(F.col("ts") / 86400).cast("int"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("resolution", "day").parquet(path)
        )

    return start(points, sink, checkpoint, trigger=trigger)
