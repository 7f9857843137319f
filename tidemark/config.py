"""Configuration of an ingest pipeline: JSON files and settings merged in order, then checked.

    {"source": {"kind": "lines", "path": "in"}, "checkpoint": "ck", "generations": "01/03/24:1", "shard_tags": ["cluster"], "every": "30s",
     "sinks": [{"kind": "points", "path": "points"}, {"kind": "parquet", "path": "copy"}], "dead": "rejected", "replies": "replies"}
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.times import Period, parse_duration, periods
from tidemark.sinks import store
from tidemark.sources import readers
from tidemark.streaming import ingest


def merged(*parts: dict) -> dict:
    """Settings of later parts over those of earlier ones; objects are merged, all else is replaced, null takes away."""
    out: dict = {}
    for part in parts:
        for k, v in part.items():
            if v is None:
                out.pop(k, None)
            elif isinstance(v, dict):
                out[k] = merged(out[k] if isinstance(out.get(k), dict) else {}, v)
            else:
                out[k] = v
    return out


def load(*sources: str | dict) -> dict:
    """Settings from JSON files, ``key.key=value`` texts and dicts, merged in order."""
    parts = []
    for s in sources:
        if isinstance(s, dict):
            parts.append(s)
        elif "=" in s and not s.endswith(".json"):
            path, _, value = s.partition("=")
            try:
                value = json.loads(value)
            except ValueError:  # plain text
                pass
            for key in reversed(path.split(".")):
                value = {key: value}
            parts.append(value)
        else:
            with open(s) as f:
                parts.append(json.load(f))
    return merged(*parts)


def generations(text: str) -> list[Period]:
    """``day:spans[,day:spans]``"""
    return periods([(d, int(n)) for d, _, n in (part.rpartition(":") for part in text.split(","))])


@dataclass(frozen=True)
class Pipeline:
    source: dict
    sinks: list[dict]
    checkpoint: str
    generations: str = "01/01/24:1"
    shard_tags: list[str] = field(default_factory=lambda: ["cluster"])
    every: str | None = None
    dead: str | None = None
    replies: str | None = None

    @staticmethod
    def of(settings: dict) -> Pipeline:
        known = {f.name for f in fields(Pipeline)}
        if strange := sorted(settings.keys() - known):
            raise ValueError(f"unknown settings {strange}")
        if missing := sorted({"source", "sinks", "checkpoint"} - settings.keys()):
            raise ValueError(f"missing settings {missing}")
        return Pipeline(**settings)


def sink_of(settings: dict, p: Pipeline, now: Callable[[], int]) -> store.Sink:
    """A sink by its kind; ``failover`` has sinks ``main`` and ``drop`` of its own."""
    kind, rest = settings.get("kind"), {k: v for k, v in settings.items() if k != "kind"}
    if kind == "failover":
        return store.failover(sink_of(rest["main"], p, now), sink_of(rest["drop"], p, now))
    if kind not in store.SINKS:
        raise ValueError(f"unknown sink {kind!r}")
    if kind == "points":
        rest = {"config": generations(p.generations), "now": now, "shard_tags": tuple(p.shard_tags)} | rest
    return store.SINKS[kind](**rest)


def start_ingest(spark: SparkSession, settings: dict, *, now: Callable[[], int] | None = None) -> StreamingQuery:
    """Start the pipeline that the settings describe."""
    p = Pipeline.of(settings)
    now = now or (lambda: int(time.time()))
    sinks = [sink_of(s, p, now) for s in p.sinks]
    tags, source = tuple(p.shard_tags), p.source
    if source.get("kind") == "lines":
        parsed = readers.read_lines(spark, source["path"], streaming=True, shard_tags=tags, files_per_batch=source.get("files_per_batch"))
    elif source.get("kind") == "socket":
        parsed = readers.read_socket_lines(spark, source["host"], source["port"], shard_tags=tags)
    else:
        raise ValueError(f"unknown source {source.get('kind')!r}")
    trigger = {"processingTime": f"{parse_duration(p.every)} seconds"} if p.every else {"availableNow": True}
    points = sinks[0] if len(sinks) == 1 else store.fan_out(*sinks)
    optional = lambda path: store.parquet_sink(path) if path else None
    return ingest.ingest_lines(parsed, points, optional(p.dead), p.checkpoint, replies=optional(p.replies), trigger=trigger)
