"""Aggregation across the series of a group at the union of their times, for Arrow batches of segments.

A segment covers the times after x1 up to x2 (a first reading its own time only).
With the times of a (group, span) sorted, it covers a run of them: adding its height
and slope where the run begins and taking them off where it ends gives all sums as
running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

PARTIALS = StructType().add("ts", IntegerType()).add("total", DoubleType()).add("n", LongType()).add("least", DoubleType()).add("most", DoubleType())
#: The value of each aggregate from the partial results.
BASIC = {"sum": "total", "avg": "total / n", "min": "least", "max": "most"}
BUFFER_ROWS = 200_000
PAIRS = 2_000_000


def _numbers(table: pa.Table, columns: int) -> np.ndarray:
    """Number of the (group, span, part) of each row; rows come sorted by them."""
    new = np.zeros(table.num_rows, bool)
    for k in range(columns):
        coded = pc.dictionary_encode(table.column(k).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= coded[1:] != coded[:-1]
    return np.cumsum(new)


def _running(begin: np.ndarray, end: np.ndarray, owner: np.ndarray, amount: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Running sums over the places of all owners (``of``), of amounts that count from one place up to another of their owner."""
    change = np.zeros(len(of) + (of[-1] if len(of) else 0) + 2, np.longdouble)  # every owner has a place more, where its last amounts end
    np.add.at(change, begin + owner, amount)
    np.subtract.at(change, end + owner, amount)
    upto = np.cumsum(change)
    before = np.searchsorted(of, of, "left") + of - 1
    return upto[np.arange(len(of)) + of] - np.where(before >= 0, upto[before], 0)  # less what rounding left of the owners before


def aggregated(table: pa.Table, groups: int, span_s: int, aggregate: str, shared: bool) -> pa.RecordBatch:
    number = _numbers(table, groups + 2)
    first_row = np.searchsorted(number, np.arange(number[-1] + 1))
    as_int = lambda c: table.column(c).to_numpy().astype(np.int64)
    start = as_int("_span") * span_s
    x1, x2 = as_int("x1"), as_int("x2")
    y1, y2 = table.column("y1").to_numpy(), table.column("y2").to_numpy()
    first, time = table.column("first").to_numpy(), table.column("_time").to_numpy()
    width = span_s + 2
    place = lambda x: number * width + np.clip(x - start, -1, span_s - 1) + 1
    asked = time if shared else (x2 >= start) & (x2 < start + span_s)
    xs = np.unique(place(x2)[asked])
    lo = np.where(first, np.searchsorted(xs, place(x1), "left"), np.searchsorted(xs, place(x1), "right"))
    hi = np.searchsorted(xs, place(x2), "right")
    active = ~time & (hi > lo)
    lo, hi, x1, x2, y1, y2, start, owner = (a[active] for a in (lo, hi, x1, x2, y1, y2, start, number))
    of, local = xs // width, xs % width - 1
    size = len(xs)
    n = _running(lo, hi, owner, np.ones(len(lo)), of).astype(np.int64)
    total, least, most = np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)
    length = np.maximum(x2 - x1, 1)
    if aggregate in ("sum", "avg"):
        slope = (y2.astype(np.longdouble) - y1) / length
        height = y1 + slope * (start - x1)
        total = (_running(lo, hi, owner, height, of) + _running(lo, hi, owner, slope, of) * local).astype(np.float64)
    else:
        count = hi - lo
        upto = np.append(0, np.cumsum(count))
        a = 0
        while a < len(count):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
            seg = np.repeat(np.arange(a, b), count[a:b])
            at = lo[seg] + np.arange(len(seg)) - (upto[seg] - upto[a])
            x = local[at] + start[seg]
            y = y1[seg] + ((y2[seg] - y1[seg]) * (x - x1[seg])) / length[seg]
            y = np.where(x == x1[seg], y1[seg], np.where(x == x2[seg], y2[seg], y))
            np.minimum.at(least, at, y)
            np.maximum.at(most, at, y)
            a = b
    there = n > 0
    rows = pa.array(first_row[of[there]])
    ts = (as_int("_span") * span_s)[first_row[of[there]]] + local[there]
    numbers = [pa.array(ts.astype(np.int32)), *(pa.array(v[there]) for v in (total, n, least, most))]
    return pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks().take(rows) for k in range(groups)), *numbers], names=[*table.schema.names[:groups], *PARTIALS.names])


def kernel(groups: int, span_s: int, aggregate: str, shared: bool):
    """Rows arrive sorted by (group, span, part); each is aggregated as a whole.  ``shared``: its times come as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, limit = 0, BUFFER_ROWS
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count < limit:
                continue
            table = pa.Table.from_batches(held)
            number = _numbers(table, groups + 2)
            cut = int(np.searchsorted(number, number[-1]))  # the last one may go on
            if cut:
                yield aggregated(table.slice(0, cut), groups, span_s, aggregate, shared)
            held, count = table.slice(cut).to_batches(), table.num_rows - cut
            limit = max(BUFFER_ROWS, 2 * count)
        if count:
            yield aggregated(pa.Table.from_batches(held), groups, span_s, aggregate, shared)

    return run
