"""Sinks: the points table, roll-ups, the queue, fan-out, failover, nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import Period, generation
from tidemark.model import tags_key
from tidemark.operators.scan import shard_column

Sink = Callable[[DataFrame, int], None]


def with_layout(points: DataFrame, *, config: list[Period], now: int, shard_tags: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """Partition columns ``gen`` and ``shard``; rows without exactly one shard tag have a null shard."""
    return points.withColumn("gen", generation("ts", config, now)).withColumn("shard", shard_column(shard_tags))


def write_points(points: DataFrame, path: str, *, batch: int | None = None) -> None:
    """Append to the points table, sorted for row-group skipping.  With ``batch`` a repeated write replaces itself.

    Newer writes of a point win when it is read (``scan.last_write``), so writing is an upsert.
    """
    rows = points.withColumn("_k", tags_key()).sortWithinPartitions("gen", "shard", "metric", "_k", "ts").drop("_k")
    if batch is None:
        rows.write.mode("append").partitionBy("gen", "shard").parquet(path)
    else:
        (
            rows.withColumn("batch", F.lit(batch).cast("long"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "gen", "shard").parquet(path)
        )


def compact(points: DataFrame, path: str) -> None:
    """Write a table with only the newest write of each point, one sorted run per generation, shard and day.

    A point is one (metric, tags, ts) with one kind of value: an integer, a float and
    lists of either stand side by side.  Of equal write times the later micro-batch
    counts, then the later row of it.  Partitions of ``path`` that ``points`` does not
    hold stay as they are.
    """
    newest = F.struct(F.coalesce("write_ms", F.lit(-(2**62))), *(F.col(c) for c in ("batch", "write_seq") if c in points.columns))
    columns = [c for c in points.columns if c not in ("gen", "shard", "batch")]
    kind = F.coalesce(*(F.when(F.col(c).isNotNull(), k) for k, c in enumerate(("int_value", "float_value", "int_list", "float_list"))))
    kept = (
        points.withColumn("_k", tags_key()).withColumn("_kind", kind)
        .groupBy("gen", "shard", "metric", "_k", "ts", "_kind").agg(F.max_by(F.struct(*columns), newest).alias("r"))
        .select("r.*", "gen", "shard", "_k")
    )
    (
        kept.repartition("gen", "shard", F.floor(F.col("ts") / 86400)).sortWithinPartitions("metric", "_k", "ts").drop("_k")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gen", "shard").parquet(path)
    )


def points_sink(path: str, *, config: list[Period], now: Callable[[], int], shard_tags: tuple[str, ...] = ("cluster",)) -> Sink:
    """Micro-batches into the points table, each under its own number: a replayed batch replaces itself."""

    def sink(df: DataFrame, number: int) -> None:
        write_points(with_layout(df, config=config, now=now(), shard_tags=shard_tags), path, batch=number)

    return sink


def blackhole(df: DataFrame, number: int) -> None:
    df.write.format("noop").mode("overwrite").save()


def failing(df: DataFrame, number: int) -> None:
    raise RuntimeError("this sink always fails")


def fan_out(*sinks: Sink) -> Sink:
    """Every batch to every sink, computed once."""

    def sink(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            for s in sinks:
                s(df, number)
        finally:
            df.unpersist()

    return sink


def failover(main: Sink, drop: Sink, *, drop_where=None) -> Sink:
    """``main`` gets what ``drop_where`` does not match; ``drop`` the rest, and the whole batch if ``main`` fails."""

    def sink(df: DataFrame, number: int) -> None:
        kept = df if drop_where is None else df.where(~F.coalesce(drop_where, F.lit(False)))
        try:
            main(kept, number)
        except Exception:  # noqa: BLE001
            drop(df, number)
            return
        if drop_where is not None:
            drop(df.where(drop_where), number)

    return sink


def parquet_sink(path: str) -> Sink:
    """Each batch in its own folder, replaced when it is replayed."""

    def sink(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def write_kafka(packs: DataFrame, servers: str, topic: str) -> None:
    """Packs (batch_id, value) keyed by batch id; needs Spark's Kafka connector on the class path."""
    packs.select(F.col("batch_id").cast("string").alias("key"), "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def partition_of(batch_id: str, partitions: int):
    """Queue partition of a batch: hash of its id."""
    return F.pmod(F.hash(batch_id), F.lit(partitions))


#: Sinks by the name a configuration uses.
SINKS: dict[str, Callable[..., Sink]] = {"points": points_sink, "parquet": parquet_sink, "blackhole": lambda: blackhole, "fail": lambda: failing}
