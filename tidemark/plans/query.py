"""Query requests: parsing, planning, execution as one DataFrame, and the JSON response."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import parse_duration
from tidemark.operators import scan as scans
from tidemark.operators import series
from tidemark.plans import planner


@dataclass(frozen=True)
class Query:
    metric: str
    aggregate: str
    start: int
    stop: int
    filters: scans.Filters = field(default_factory=dict)
    interval: int | None = None
    downsampler: str | None = None
    rate: bool = False

    def __post_init__(self) -> None:
        for a in (self.aggregate, *([self.downsampler] if self.downsampler else [])):
            if a not in series.AGGREGATES:
                raise ValueError(f"unknown aggregate {a!r}")
        if self.start >= self.stop:
            raise ValueError("start must lie before the end")


def parse_downsample(text: str) -> tuple[int, str]:
    """``10m-avg``: seconds and aggregate."""
    duration, dash, aggregate = text.partition("-")
    if not dash:
        raise ValueError(f"not an interval and aggregate: {text!r}")
    return parse_duration(duration), aggregate


def parse_request(body: str | dict, now_ms: int | None = None) -> list[Query]:
    """The queries of a JSON request: start and end in milliseconds, metric, aggregator, tags, downsample, rate."""
    r = json.loads(body) if isinstance(body, str) else body
    end_ms = r.get("end", now_ms if now_ms is not None else int(time.time() * 1000))
    out = []
    for q in r["queries"]:
        interval, down = parse_downsample(q["downsample"]) if q.get("downsample") else (None, None)
        filters = {k: scans.parse_filter(v) for k, v in q.get("tags", {}).items()}
        out.append(Query(q["metric"], q["aggregator"], int(r["start"]) // 1000, int(end_ms) // 1000, filters, interval, down, bool(q.get("rate", False))))
    return out


def parse_url(metric: str, params: dict[str, str]) -> Query:
    """The short form: start, end in seconds, attrs, agrg, dsagrg and dsint."""
    interval = int(params["dsint"]) if params.get("dsint") else None
    return Query(
        metric, params["agrg"], int(params["start"]), int(params["end"]), scans.parse_arrow_filters(params.get("attrs", "")), interval, params.get("dsagrg") if interval else None
    )


def run(points: DataFrame, q: Query, rollups: DataFrame | None = None, *, strict: bool = False) -> DataFrame:
    """``metric, group_tags, ts, value``: scan, downsample per series, rate per series, interpolate, aggregate.

    ``rollups`` (metric, tags, tags_key, ts, value, resolution, agg) serve a
    downsampling request where they are there.  An unknown metric gives an empty
    result; ``strict`` raises if no series has two readings.
    """
    names = scans.group_names(q.filters)

    def fetch(resolution: str | None, start: int, stop: int) -> DataFrame:
        if resolution is None:
            return scans.scan(points, q.metric, start, stop, q.filters).select("tags_key", "tags", "ts", "is_float", "value")
        kept = (F.col("metric") == q.metric) & (F.col("resolution") == resolution) & (F.col("agg") == q.downsampler)
        return rollups.where(kept & scans.time_predicate(start, stop) & scans.tag_predicate(q.filters)).select("tags_key", "tags", "ts", F.lit(False).alias("is_float"), F.col("value").cast("double").alias("value"))

    grouped = [f"g_{n}" for n in names]

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("tags_key", *(F.col("tags")[n].alias(g) for n, g in zip(names, grouped)), "ts", "is_float", "value")

    keys = [*grouped, "tags_key"]
    if q.interval is None:
        rows = keyed(fetch(None, q.start, q.stop))
    elif rollups is None:
        rows = series.downsample(keyed(fetch(None, q.start, q.stop)), keys, q.interval, q.downsampler)
    else:
        rows = planner.stitched(lambda r, a, b: keyed(fetch(r, a, b)), q.start, q.stop, q.interval, q.downsampler, keys)
    order = ["ts", "is_float"] if q.interval is None else ["ts"]  # of two kinds of value at one time the integer comes first
    if q.rate:
        rows, order = series.rate(rows, keys, order=order), ["ts"]
    if strict and not rows.groupBy(*keys).count().where("count > 1").take(1):
        raise ValueError("no series has two readings")
    if q.interval is None:
        out = series.aggregate_union_grid(rows, keys, grouped, q.aggregate, order=order)
    else:
        out = series.aggregate_fixed_grid(rows, keys, grouped, q.aggregate, q.interval)
    tags = F.create_map(*(x for n, g in zip(names, grouped) for x in (F.lit(n), F.col(g)))) if names else F.create_map().cast("map<string,string>")
    return out.select(F.lit(q.metric).alias("metric"), tags.alias("group_tags"), "ts", "value")


def json_result(result: DataFrame) -> DataFrame:
    """One JSON object per group: ``{"metric", "tags", "dps": {ts: value}}``."""
    in_order = F.sort_array(F.collect_list(F.struct("ts", "value")))
    dps = F.map_from_entries(F.transform(in_order, lambda p: F.struct(p["ts"].cast("string").alias("key"), p["value"].alias("value"))))
    keyed = result.withColumn("_k", F.to_json(F.map_from_entries(F.sort_array(F.map_entries("group_tags")))))
    return keyed.groupBy("metric", "_k").agg(F.first("group_tags").alias("tags"), dps.alias("dps")).select(F.to_json(F.struct("metric", "tags", "dps")).alias("json"))


def text_result(result: DataFrame) -> DataFrame:
    """Per group a line with its tags, then one line per point, as rows ``group, ord, line``."""
    group = F.array_join(F.transform(F.sort_array(F.map_entries("group_tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    x = result.withColumn("group", group)
    heads = x.select("group").distinct().select("group", F.lit(-1).alias("ord"), F.col("group").alias("line"))
    return heads.unionByName(x.select("group", F.col("ts").alias("ord"), F.concat_ws(" ", F.col("ts").cast("string"), F.col("value").cast("string")).alias("line")))
