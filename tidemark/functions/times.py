"""Durations, buckets, and generations (time partitions of the store)."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the duration units (fixed values).
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "y": 365 * 86400}
#: Generations are counted in spans of 14 days (fixed value).
SPAN_S = 14 * 86400
OUTSIDE = -1


def parse_duration(text: str) -> int:
    """Seconds of ``10m``, ``1h``, ``2w``."""
    number, unit = text[:-1], text[-1:]
    if unit not in UNITS or not number.isdigit() or int(number) <= 0:
        raise ValueError(f"not a duration: {text!r}")
    return int(number) * UNITS[unit]


def bucket_start(ts: str | Column, interval: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - ts % interval


def bucket_centre(ts: str | Column, interval: int) -> Column:
    """Start of the bucket plus half its length, in whole seconds."""
    return (bucket_start(ts, interval) + interval // 2).cast("int")


@dataclass(frozen=True)
class Period:
    """From ``start`` on, generations last ``spans`` times 14 days and are numbered from ``first``."""

    start: int
    spans: int
    first: int


def periods(entries: list[tuple[str, int]]) -> list[Period]:
    """Periods from (day as dd/mm/yy, number of 14-day spans); days are floored to the span, sorted by time."""
    starts = []
    for day, spans in entries:
        moment = datetime.datetime.strptime(day, "%d/%m/%y").replace(tzinfo=datetime.timezone.utc)
        second = int(moment.timestamp())
        starts.append((second - second % SPAN_S, spans))
    starts.sort()
    out: list[Period] = []
    for start, spans in starts:
        first = 0
        if out:
            last = out[-1]
            length = last.spans * SPAN_S
            first = last.first + -(-(start - last.start) // length)
        out.append(Period(start, spans, first))
    return out


def generation(ts: str | Column, config: list[Period], now: int) -> Column:
    """Number of the generation of a time; -1 before the first one and more than one length ahead of ``now``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    out = F.lit(OUTSIDE)
    for k, p in enumerate(config):
        length = p.spans * SPAN_S
        inside = ts >= p.start
        if k + 1 < len(config):
            inside &= ts < config[k + 1].start
        number = (F.lit(p.first) + F.floor((ts - p.start) / length)).cast("int")
        out = F.when(inside, F.when(ts >= now + length, OUTSIDE).otherwise(number)).otherwise(out)
    return out.cast("smallint")


def generation_ranges(config: list[Period], start: int, stop: int) -> list[tuple[int, int, int]]:
    """(start, stop, generation) of the generations that overlap [start, stop), trimmed to it, oldest first."""
    out = []
    for k, p in enumerate(config):
        length, end = p.spans * SPAN_S, config[k + 1].start if k + 1 < len(config) else stop
        at, number = p.start, p.first
        if start > at:
            number += (start - at) // length
            at += (start - at) // length * length
        while at < min(end, stop):
            upto = min(at + length, end)
            if upto > start:
                out.append((max(at, start), min(upto, stop), number))
            at, number = at + length, number + 1
    return out


def recent_generations(config: list[Period], now: int, most: int = 3) -> list[int]:
    """The newest generations up to ``now``, newest first."""
    if not config or now < config[0].start:
        return []
    return [g for _, _, g in generation_ranges(config, config[0].start, now + 1)][::-1][:most]
