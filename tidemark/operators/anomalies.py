"""Implausible readings per source: physical limits, control charts, run lengths.

Every source is judged by its own behaviour: a robust exponentially weighted
control chart runs over its readings forwards and backwards, suspected values are
clipped before they enter mean and scale, a run-length counter finds frozen values,
and the metric's possible range decides on impossible ones.

Scale.  A source is cut into chunks of ``chunk_steps`` intended intervals.  Each
chunk also gets ``halo_steps`` intervals of its neighbours as context, far more
than the chart's memory, so that no task ever needs a whole source: the largest
sorted group is one chunk of one source, whatever share of the rows a source has.
One shuffle; all chunks of a task are processed together as padded matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import readings, series_key
from tidemark.operators import charts

FLAGS_DDL = "point_id BIGINT, impossible BOOLEAN, spike BOOLEAN, frozen BOOLEAN"
BUFFER_ROWS = 150_000
CELLS = 1_500_000
#: Beside a spike, a reading belongs to it from this share of the usual distance on.
BESIDE_AT = 0.75


def judge(part: dict[str, np.ndarray], spike_at: float, chart: dict) -> np.ndarray:
    """Flags (rows x impossible, spike, frozen) of whole chunks, rows sorted by chunk, time and write.

    Equal times within a chunk are deliveries of one point: the last possible one
    stands for it in the chart, the others are judged at its place.
    """
    ts, value, bad, group = part["ts"], part["value"], part["bad"], part["group"]
    flags = np.zeros((len(ts), 3), dtype=bool)
    flags[:, 0] = bad
    ok = np.flatnonzero(~bad)
    if not len(ok):
        return flags
    g, t, v = group[ok], ts[ok], value[ok]
    last = np.ones(len(ok), dtype=bool)
    last[:-1] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    place = np.cumsum(last) - last  # number of the distinct (chunk, time) a row belongs to
    gg, vv = g[last], v[last]
    new = np.ones(len(gg), dtype=bool)
    new[1:] = gg[1:] != gg[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(gg)))
    spike, frozen = np.zeros(len(ok), dtype=bool), np.zeros(len(gg), dtype=bool)
    first_row = np.searchsorted(place, np.arange(len(gg) + 1))
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * size[order[hi]] <= CELLS:
            hi += 1
        some = order[lo:hi]
        lo = hi
        n = size[some]
        row = np.repeat(np.arange(len(some)), n)
        col = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(start[some], n) + col
        v2 = np.full((len(some), n.max()), np.nan)
        v2[row, col] = vv[at]
        centres = charts.two_way(v2, n, **chart)
        frozen[at] = charts.frozen(v2, n)[row, col]
        count = first_row[at + 1] - first_row[at]
        rows = np.repeat(first_row[at], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        here = [np.repeat(x[row, col], count) for x in centres]
        needed = charts.beside(charts.stands_out(v2, *centres) > spike_at)
        spike[rows] = charts.stands_out(v[rows], *here) > np.where(np.repeat(needed[row, col], count), BESIDE_AT * spike_at, spike_at)
    flags[ok, 1] = spike
    flags[ok, 2] = frozen[place] & (v == vv[place])
    return flags


def chunk_kernel(spike_at: float, halo_rows: int, group_rows: int, chart: dict):
    names = ("a", "b", "chunk", "ts", "value", "bad", "core", "point_id")

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}

    def emit(held: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        new = np.ones(len(held["ts"]), dtype=bool)
        new[1:] = False
        for k in ("a", "b", "chunk"):
            new[1:] |= held[k][1:] != held[k][:-1]
        flags = judge(held | {"group": np.cumsum(new)}, spike_at, chart)
        out = flags.any(axis=1) & held["core"]
        if not out.any():
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(held["point_id"][out]), *(pa.array(flags[out, k]) for k in range(3))],
            names=["point_id", "impossible", "spike", "frozen"],
        )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict[str, np.ndarray]] = []
        rows = 0

        def gathered() -> dict[str, np.ndarray]:
            return {k: np.concatenate([p[k] for p in parts]) for k in names}

        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(columns(batch))
            rows += batch.num_rows
            if rows < BUFFER_ROWS:
                continue
            held = gathered()
            same = (held["a"] == held["a"][-1]) & (held["b"] == held["b"][-1]) & (held["chunk"] == held["chunk"][-1])
            cut = int(np.argmax(same))  # the last chunk may go on in the next batch
            if cut:
                if (out := emit({k: x[:cut] for k, x in held.items()})) is not None:
                    yield out
                keep = {k: x[cut:] for k, x in held.items()}
            elif rows >= group_rows:  # one huge chunk: go on by rows, with context on both sides
                now = held | {"core": held["core"] & (np.arange(rows) < rows - halo_rows)}
                if (out := emit(now)) is not None:
                    yield out
                keep = {k: x[-2 * halo_rows :].copy() for k, x in held.items()}
                keep["core"][:halo_rows] = False
            else:
                keep = held
            parts, rows = [keep], len(keep["ts"])
        if rows and (out := emit(gathered())) is not None:
            yield out

    return kernel


def flag_readings(
    points: DataFrame,
    catalog: DataFrame,
    *,
    chunk_steps: int = 4096,
    halo_steps: int = 512,
    spike_at: float = 5.5,
    group_rows: int = 2_000_000,
    **chart: float,
) -> DataFrame:
    """Flagged readings: ``point_id, impossible, spike, frozen`` (each stored row once).

    points: point_id, metric, tags, ts, int_value, float_value, write_ms; catalog:
    metric, step_s, lowest, highest.  Extra columns are ignored.  Judged are readings
    (rows with a value, a source and a time) of metrics with a positive ``step_s``.
    A null ``lowest`` or ``highest`` is no limit, NaN and infinities are impossible.
    Deliveries of one (source, ts) stand at one place of the series, in order of
    write_ms (null first) and point_id; repeats never lengthen a run.  A chunk of more
    than ``group_rows`` rows (hundreds in every intended interval) is judged in parts
    of that many, each with ``halo_steps`` rows of context on both sides, as a task
    holds one part at a time.  Empty input gives an empty result.
    """
    limits = catalog.where(F.col("step_s") > 0).groupBy("metric").agg(
        F.max("step_s").alias("step_s"), F.max("lowest").alias("lowest"), F.max("highest").alias("highest")
    )
    x = (
        readings(points.select("point_id", "metric", "tags", "ts", "int_value", "float_value", "write_ms"))
        .join(limits, "metric")
        .withColumn("key", series_key())
    )
    value = F.col("value")
    infinite = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    bad = infinite | F.coalesce(value < F.col("lowest"), F.lit(False)) | F.coalesce(value > F.col("highest"), F.lit(False))
    length, halo = F.col("step_s").cast("long") * chunk_steps, F.col("step_s").cast("long") * halo_steps
    own = F.floor(F.col("ts") / length)
    offset = F.col("ts") - own * length
    chunks = F.filter(
        F.array(
            own,
            F.when(offset < halo, own - 1),
            F.when(offset >= length - halo, own + 1),
        ),
        lambda c: c.isNotNull(),
    )
    # 128 bits of hash stand for the source: two sources share a chart only if both halves collide
    x = x.select(
        F.xxhash64("key").alias("a"),
        F.xxhash64(F.lit("second half"), F.col("key")).alias("b"),
        own.alias("own"),
        F.explode(chunks).alias("chunk"),
        "ts", "value", bad.alias("bad"), "point_id", "write_ms",
    )
    x = (
        x.repartition("a", "b", "chunk")
        .sortWithinPartitions("a", "b", "chunk", "ts", F.col("write_ms").asc_nulls_first(), "point_id")
        .select("a", "b", "chunk", "ts", "value", "bad", (F.col("own") == F.col("chunk")).alias("core"), "point_id")
    )
    return x.mapInArrow(chunk_kernel(spike_at, halo_steps, group_rows, chart), FLAGS_DDL)
