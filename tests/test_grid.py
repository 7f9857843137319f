from collections import defaultdict

import pytest

from tests.points import catalog, frame, gauge
from tidemark.operators import grid

CATALOG = [{"metric": "m.x", "step_s": 60}, {"metric": "m.none", "step_s": None}]


def cells(spark, rows, **how):
    return sorted((r.series_key, r.ts) for r in grid.regular_grid(frame(spark, rows), catalog(spark, CATALOG), **how).where("filled").collect())


@pytest.mark.parametrize("sign", [1, -1])  # a counter and a gauge
@pytest.mark.parametrize("chunk_steps", [4096, 7])
def test_uncovered_periods(spark, chunk_steps, sign):
    times = [3, 62, 300, 301, 1300, 1299, 1300, 5000]
    rows = [{"metric": "m.x", "tags": {"b": "2", "a": "1"}, "ts": t, "int_value": sign * t, "write_ms": None} for t in times]
    rows += [{"metric": "m.x", "tags": {"a": "9"}, "ts": 100, "int_value": 1}, {"metric": "m.none", "tags": {"a": "9"}, "ts": 10, "int_value": 1}, {"metric": "m.x", "tags": {"a": "1", "b": "2"}, "ts": 700, "int_value": None}]
    have = {t // 60 for t in times}
    want = [("m.x{a=1,b=2}", k * 60) for k in range(0, 5000 // 60) if k not in have]
    assert cells(spark, rows, chunk_steps=chunk_steps) == sorted(want)


def test_no_rows(spark):
    assert cells(spark, []) == []
    assert grid.regular_grid(frame(spark, []), catalog(spark, CATALOG)).collect() == []


def test_grid_fills_and_marks(spark):
    rows = gauge([2.0, 1.0], step=240, start=6000) + gauge([9.0], start=6000, write_ms=0)
    got = sorted((r.ts, r.n_readings, r.value, r.filled, r.counter) for r in grid.regular_grid(frame(spark, rows), catalog(spark, CATALOG)).collect())
    assert got == [(6000, 1, 2.0, False, False), (6060, 0, 1.75, True, False), (6120, 0, 1.5, True, False), (6180, 0, 1.25, True, False), (6240, 1, 1.0, False, False)]


def test_counters_are_told_by_their_readings_and_not_interpolated_over_resets(spark):
    values = [k * 10 for k in range(40)]
    rows = [{"metric": "m.x", "tags": {"a": "1"}, "ts": 60 * k, "int_value": v} for k, v in enumerate(values)] + [{"metric": "m.x", "tags": {"a": "1"}, "ts": 60 * 43, "int_value": 8}, {"metric": "m.x", "tags": {"a": "lone"}, "ts": 61, "int_value": 5}]
    got = {(r.series_key, r.ts): (r.n_readings, r.value, r.filled) for r in grid.regular_grid(frame(spark, rows), catalog(spark, CATALOG)).where("counter").collect()}
    assert got["m.x{a=1}", 60 * 5] == (1, 10.0, False) and got["m.x{a=1}", 60 * 41] == (0, 2.0, True) and got["m.x{a=1}", 60 * 43] == (1, 0.0, False)
    assert got["m.x{a=lone}", 60] == (1, None, False) and len(got) == 45


@pytest.mark.parametrize("chunk_steps", [4096, 3])
def test_increments_follow_the_overlap_and_resets(spark, chunk_steps):
    readings = [(10, 0), (50, 40), (130, 120), (250, 30), (251, 31)]
    rows = [{"metric": "m.x", "tags": {"a": "1"}, "ts": t, "int_value": v} for t, v in readings]
    pairs = grid.consecutive_pairs(grid.source_readings(frame(spark, rows), catalog(spark, CATALOG)), chunk_steps=chunk_steps)
    want, resets = defaultdict(float), 0
    for (t0, v0), (t1, v1) in zip(readings, readings[1:]):
        for s in range(t0, t1):
            want[s // 60 * 60] += (v1 - v0 if v1 >= v0 else v1) / (t1 - t0)
        resets += v1 < v0
    got = {r.ts: r.increment for r in grid.increments(pairs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert sum(r.resets for r in grid.increments(pairs).collect()) == resets
