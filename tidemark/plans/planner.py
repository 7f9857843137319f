"""Choice of stored resolutions for a request, and stitching of what is missing from finer data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rollup import RESOLUTIONS
from tidemark.operators.series import downsample

RAW = None


def candidates(interval: int | None) -> list[str | None]:
    """Resolutions that can serve an interval, coarsest first; raw readings (None) always last."""
    usable = [r for r, s in sorted(RESOLUTIONS.items(), key=lambda e: -e[1]) if interval is not None and s <= interval]
    return [*usable, RAW]


def next_start(last_ts: int | None, resolution: str, start: int) -> int:
    """Where stored roll-ups end: the bucket after the last one found, or ``start`` if there is none."""
    if last_ts is None:
        return start
    step = RESOLUTIONS[resolution]
    return last_ts - last_ts % step + step


def stitched(
    fetch: Callable[[str | None, int, int], DataFrame],
    start: int,
    stop: int,
    interval: int | None,
    aggregate: str | None,
    keys: list[str],
) -> DataFrame:
    """Readings of [start, stop), downsampled to ``interval``, from the coarsest roll-ups that are there.

    ``fetch(resolution, start, stop)`` gives ``keys, ts, value``.  After the last
    roll-up of a resolution the next finer one goes on, raw readings last.  Each part
    is downsampled by itself, so that a bucket across a seam may appear twice.  One
    small action (a maximum) per stored resolution.
    """
    if interval is None:
        return fetch(RAW, start, stop)
    parts, at = [], start
    for resolution in candidates(interval):
        part = fetch(resolution, at, stop)
        parts.append(downsample(part, keys, interval, aggregate))
        if resolution is RAW:
            break
        last = part.agg(F.max("ts")).first()[0]
        at = next_start(last, resolution, at)
        if at >= stop:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
