"""Readers: stored points and roll-ups, lines, JSON bodies, the queue, and generated load."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lines as parsing
from tidemark.functions.times import Period, generation_ranges
from tidemark.sources import packs


def read_points(spark: SparkSession, path: str, *, start: int | None = None, stop: int | None = None, config: list[Period] | None = None, shards: list[str] | None = None) -> DataFrame:
    """Stored points; partitions outside the generations and shards are never listed in the plan.

    Points outside all generations (gen -1) are not read.
    """
    df = spark.read.parquet(path)
    if config is not None and start is not None and stop is not None:
        df = df.where(F.col("gen").isin(sorted({g for _, _, g in generation_ranges(config, start, stop)})))
    elif "gen" in df.columns:
        df = df.where(F.col("gen") >= 0)
    if shards is not None:
        df = df.where(F.col("shard").isin(shards))
    if start is not None:
        df = df.where(F.col("ts") >= start)
    if stop is not None:
        df = df.where(F.col("ts") < stop)
    return df


def read_lines(spark: SparkSession, path: str, *, streaming: bool = False, shard_tags: tuple[str, ...] = ("cluster",), files_per_batch: int | None = None) -> DataFrame:
    """Parsed line protocol from text files, in batch or as a stream."""
    reader = spark.readStream if streaming else spark.read
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parsing.parse_lines(reader.text(path).withColumnRenamed("value", "line"), shard_tags=shard_tags)


def read_socket_lines(spark: SparkSession, host: str, port: int, *, shard_tags: tuple[str, ...] = ("cluster",)) -> DataFrame:
    raw = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return parsing.parse_lines(raw.withColumnRenamed("value", "line"), shard_tags=shard_tags)


def read_line_streams(spark: SparkSession, path: str, *, shard_tags: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """Parsed lines of recorded streams (one file each) that may hold ``deflate N`` and ``snappy N`` frames.

    A frame that cannot be opened is a row whose error says so.
    """
    lines = packs.open_streams(spark.read.format("binaryFile").load(path).select("content"))
    parsed = parsing.parse_lines(lines, shard_tags=shard_tags)
    return parsed.withColumn("error", F.coalesce("frame_error", "error")).drop("frame_error")


def read_json(spark: SparkSession, path: str, *, per_line: bool = False) -> DataFrame:
    """Points of JSON bodies, one per file or one per line, rejected ones with their error."""
    return parsing.parse_json_points(spark.read.text(path, wholetext=not per_line).withColumnRenamed("value", "body"))


Ranges = list[tuple[str, int, int, int]]


def kafka_reads(ranges: Ranges) -> list[tuple[str, str, str]]:
    """Options assign, startingOffsets and endingOffsets of bounded reads that together cover all ranges.

    One read takes one range of each partition; further ranges of a partition go to
    further reads.  Ranges without a message are left out; overlapping ones are joined,
    so that no message is read twice.
    """
    per: dict[tuple[str, int], list[list[int]]] = {}
    for topic, partition, start, stop in sorted(ranges):
        if stop <= start:
            continue
        mine = per.setdefault((topic, partition), [])
        if mine and start <= mine[-1][1]:
            mine[-1][1] = max(mine[-1][1], stop)
        else:
            mine.append([start, stop])
    out = []
    for k in range(max(map(len, per.values()), default=0)):
        assign: dict[str, list[int]] = {}
        starts: dict[str, dict[str, int]] = {}
        stops: dict[str, dict[str, int]] = {}
        for (topic, partition), mine in per.items():
            if k < len(mine):
                assign.setdefault(topic, []).append(partition)
                starts.setdefault(topic, {})[str(partition)], stops.setdefault(topic, {})[str(partition)] = mine[k]
        out.append(tuple(json.dumps(x, sort_keys=True) for x in (assign, starts, stops)))
    return out


def parse_ranges(text: str) -> list[tuple[str, int, int, int]]:
    """``topic,partition,start,stop;...``"""
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        topic, partition, start, stop = part.split(",")
        out.append((topic, int(partition), int(start), int(stop)))
    return out


def read_kafka(spark: SparkSession, servers: str, topics: list[str], *, ranges: Ranges | None = None, streaming: bool = False, most_per_batch: int | None = None) -> DataFrame:
    """Packs of a queue: exactly the given ranges of offsets in batch, or a stream.  Needs Spark's Kafka connector on the class path."""
    if streaming:
        if ranges is not None:
            raise ValueError("a stream has no ranges; its checkpoint keeps the offsets")
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
        return (reader.option("maxOffsetsPerTrigger", most_per_batch) if most_per_batch else reader).load()
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", servers)
    if ranges is None:
        return reader.option("subscribe", ",".join(topics)).load()
    out = None
    for assign, starts, stops in kafka_reads([r for r in ranges if r[0] in topics]):
        one = reader.option("assign", assign).option("startingOffsets", starts).option("endingOffsets", stops).load()
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("the ranges hold no message")
    return out


def sine_points(spark: SparkSession, *, start: int, stop: int, step: int, periods: list[int], amps: list[int], shifts: list[int], metric: str = "sin", cluster: str = "c0") -> DataFrame:
    """Generated series: one per period, amplitude and shift."""
    two_pi = 6.283185307179586
    combos = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.lit(a).alias("amp"), F.lit(s).alias("shift")) for p in periods for a in amps for s in shifts)))
    x = spark.range(start, stop, step).select(F.col("id").cast("int").alias("ts"), combos.alias("c")).select("ts", "c.*")
    value = (F.sin(((F.col("ts") + F.col("shift")) % F.col("period")) / F.col("period") * two_pi).cast("float") * F.col("amp")).cast("float")
    tags = F.create_map(*(v for n in ("period", "amp", "shift") for v in (F.lit(n), F.col(n).cast("string"))), F.lit("cluster"), F.lit(cluster))
    return x.select(
        F.lit(metric).alias("metric"), tags.alias("tags"), "ts", F.lit("FLOAT").alias("value_type"), F.lit(None).cast("long").alias("int_value"), value.alias("float_value"),
        F.lit(None).cast("array<bigint>").alias("int_list"), F.lit(None).cast("array<float>").alias("float_list"), F.lit(0).cast("long").alias("write_ms"),
    )


def generated_lines(spark: SparkSession, n: int, *, start: int = 1_700_000_000, metric: str = "gen.load", cluster: str = "c0") -> DataFrame:
    """``put`` lines one second apart."""
    return spark.range(n).select(F.format_string(f"put {metric} %d %d host=h%d cluster={cluster}", F.col("id") + start, F.col("id") % 1000, F.col("id") % 16).alias("line"))
