"""Command line: ``python -m tidemark.cli ingest|pipeline|query|rollup|suggest|health ...`` (run with spark-submit on a cluster)."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from tidemark import config
from tidemark.functions.times import parse_duration
from tidemark.operators import health, names, rollup, scan
from tidemark.plans import query as requests
from tidemark.sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)

    one = sub.add_parser("ingest", help="line protocol files into the points table")
    one.add_argument("lines")
    one.add_argument("points")
    one.add_argument("--dead", help="folder of rejected lines")
    one.add_argument("--checkpoint", required=True)
    one.add_argument("--every", help="trigger interval, such as 30s; without it everything that is there once")
    one.add_argument("--generations", default="01/01/24:1", help="day:spans[,day:spans]")
    one.add_argument("--shard-tags", default="cluster")

    one = sub.add_parser("pipeline", help="ingest as settings describe it")
    one.add_argument("settings", nargs="+", help="JSON files and key.key=value, later ones over earlier ones")

    one = sub.add_parser("query", help="answer a JSON request")
    one.add_argument("points")
    one.add_argument("request", help="JSON, or @file")
    one.add_argument("--rollups")

    one = sub.add_parser("rollup", help="roll up a range of days")
    one.add_argument("points", help="points table, or hour roll-ups for the strategy day")
    one.add_argument("rollups")
    one.add_argument("--start", type=int, required=True)
    one.add_argument("--stop", type=int, required=True)
    one.add_argument("--granularity", choices=sorted(rollup.STRATEGIES), required=True)

    one = sub.add_parser("suggest", help="names that start with a prefix")
    one.add_argument("points")
    one.add_argument("type", choices=sorted(names.KINDS))
    one.add_argument("prefix")
    one.add_argument("--max", type=int, default=25)

    one = sub.add_parser("health", help="did the number of a tag's values fall?")
    one.add_argument("points")
    one.add_argument("metric")
    one.add_argument("tag")
    one.add_argument("interval")
    one.add_argument("--fixed", default="", help="tag value[,tag value]")
    one.add_argument("--now", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out: list[str] = []
    if a.command == "ingest":
        settings = {
            "source": {"kind": "lines", "path": a.lines}, "sinks": [{"kind": "points", "path": a.points}], "checkpoint": a.checkpoint, "dead": a.dead, "every": a.every,
            "generations": a.generations, "shard_tags": a.shard_tags.split(","),
        }
        config.start_ingest(spark, settings).awaitTermination()
    elif a.command == "pipeline":
        config.start_ingest(spark, config.load(*a.settings)).awaitTermination()
    elif a.command == "query":
        body = open(a.request[1:]).read() if a.request.startswith("@") else a.request
        stored = spark.read.parquet(a.rollups) if a.rollups else None
        points = readers.read_points(spark, a.points)
        for q in requests.parse_request(body):
            out += [r.json for r in requests.json_result(requests.run(points, q, stored)).collect()]
    elif a.command == "rollup":
        source = spark.read.parquet(a.points)
        if a.granularity == "hour":
            source = scan.last_write(readers.read_points(spark, a.points, start=a.start, stop=a.stop), tie=None)
        rollup.roll_up_job(source, a.start, a.stop, a.granularity, a.rollups, ["metric", "tags_key"])
    elif a.command == "suggest":
        table = names.name_table(readers.read_points(spark, a.points))
        out = [r.name for r in names.suggest(table, a.type, a.prefix, a.max).collect()]
    else:
        now = a.now if a.now is not None else int(time.time())
        r = health.health_check(readers.read_points(spark, a.points), a.metric, a.tag, now, parse_duration(a.interval), scan.parse_fixed_tags(a.fixed)).first()
        out = [json.dumps(r.asDict())]
    return out


if __name__ == "__main__":
    for line in main():
        print(line)
