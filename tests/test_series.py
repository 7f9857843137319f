import random

import pytest

from tidemark.operators import series

DDL = "g STRING, s INT, ts INT, value DOUBLE"


def frame(spark, groups):
    return spark.createDataFrame([(g, s, t, float(v)) for g, rows in groups.items() for s, pts in enumerate(rows) for t, v in pts], DDL)


def line(pts, x):
    """Value of a series at x by its definition, None outside."""
    for (x1, y1), (x2, y2) in zip(pts, pts[1:]):
        if x1 <= x <= x2:
            return y1 if x == x1 else y2 if x == x2 else y1 + ((y2 - y1) * (x - x1)) / (x2 - x1)
    return None


def slow_union(rows, f):
    rows = [r for r in rows if len(r) > 1]
    xs = sorted({x for r in rows for x, _ in r})
    return [(x, f([y for r in rows if (y := line(r, x)) is not None])) for x in xs]


def slow_grid(rows, f, i):
    rows = [r for r in rows if len(r) > 1]
    if not rows:
        return []
    first, last = min(r[0][0] for r in rows), max(r[-1][0] for r in rows)
    out, x = [], first - first % i + i // 2
    while x <= last:
        ys = [y for r in rows if (y := line(r, x)) is not None]
        if not ys:
            break
        out.append((x, f(ys)))
        x += i
    return out


def slow_down(pts, f, i):
    buckets = {}
    for x, y in pts:
        buckets.setdefault(x - x % i + i // 2, []).append(y)
    return sorted((x, f(ys)) for x, ys in buckets.items())


F = {"max": max, "min": min, "sum": sum, "avg": lambda v: sum(v) / len(v)}


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.g, []).append((r.ts, r.value))
    return {g: sorted(v) for g, v in out.items()}


def random_groups(seed, groups=5, n=8):
    rnd = random.Random(seed)
    out = {}
    for g in range(groups):
        rows = []
        for _ in range(n):
            t, pts = rnd.randrange(400), []
            for _ in range(rnd.choice([1, 2, 3, 20, 50])):
                t += rnd.randrange(1, 100)
                pts.append((t, rnd.random()))
            rows.append(pts)
        out[f"g{g}"] = rows
    return out


@pytest.mark.parametrize("aggregate", ["max", "min", "avg", "sum", "sum_by_join"])
@pytest.mark.parametrize("chunk_s, parts", [(86400, 1), (90, 1), (90, 3)])
def test_union_grid_against_the_definition(spark, monkeypatch, aggregate, chunk_s, parts):
    monkeypatch.setattr(series.union, "BUFFER_ROWS", 40)
    monkeypatch.setattr(series.union, "PAIRS", 7)
    series.register_aggregate("sum_by_join", series.F.sum)
    groups = random_groups(1)
    got = collected(series.aggregate_union_grid(frame(spark, groups), ["s"], ["g"], aggregate, span_s=70, chunk_s=chunk_s, parts=parts))
    aggregate = aggregate[:3]
    for g, rows in groups.items():
        want = slow_union(rows, F[aggregate])
        assert [x for x, _ in got.get(g, [])] == [x for x, _ in want]
        assert [y for _, y in got.get(g, [])] == pytest.approx([y for _, y in want])


@pytest.mark.parametrize("interval", [10, 37, 209])
@pytest.mark.parametrize("chunk_s, chunk", [(86400, 4096), (90, 4096), (90, 3), (90, 1)])
def test_fixed_grid_against_the_definition(spark, interval, chunk_s, chunk):
    groups = random_groups(2)
    got = collected(series.aggregate_fixed_grid(frame(spark, groups), ["s"], ["g"], "max", interval, chunk_s=chunk_s, chunk=chunk))
    for g, rows in groups.items():
        want = slow_grid(rows, max, interval)
        assert [x for x, _ in got.get(g, [])] == [x for x, _ in want]
        assert [y for _, y in got.get(g, [])] == pytest.approx([y for _, y in want])


@pytest.mark.parametrize(
    "rows,interval,want",
    [
        ([[(0, 0), (10, 0)]] * 3, 10, [(5, 0)]),
        ([[(k, k) for k in range(1, 6)]] * 5, 1, [(k, k) for k in range(1, 6)]),
        ([[(20, 0), (30, 0)], [(0, 0), (10, 0)]], 10, [(5, 0)]),
        ([[(9, 0), (30, 0)]], 10, []),
        ([[(5, 1)]], 10, []),
    ],
)
def test_fixed_grid_cases(spark, rows, interval, want):
    for chunk in (4096, 2):
        assert collected(series.aggregate_fixed_grid(frame(spark, {"a": rows}), ["s"], ["g"], "max", interval, chunk=chunk)).get("a", []) == want
        one = series.aggregate_fixed_grid(frame(spark, {"a": rows}).drop("g"), ["s"], [], "max", interval, chunk=chunk)
        assert sorted(tuple(r) for r in one.collect()) == want


def test_union_grid_cases(spark):
    pts = [(k, k) for k in range(1, 6)]
    assert collected(series.aggregate_union_grid(frame(spark, {"a": [pts]}), ["s"], ["g"], "max"))["a"] == pts
    assert collected(series.aggregate_union_grid(frame(spark, {"a": [pts] * 5}), ["s"], ["g"], "avg"))["a"] == pts
    one_group = frame(spark, {"a": [pts, [(2, 10), (4, 10)]]}).drop("g")
    assert sorted(tuple(r) for r in series.aggregate_union_grid(one_group, ["s"], [], "sum").collect()) == [(1, 1), (2, 12), (3, 13), (4, 14), (5, 5)]


def test_segments_and_null_groups(spark):
    pts = [(k, 0.0) for k in range(6)]
    assert series.segments(frame(spark, {"a": [pts, [(3, 1.0)]]}), ["g", "s"]).count() == 5
    df = spark.createDataFrame([(None, 1, 0, 1.0), (None, 1, 10, 3.0), ("b", 1, 0, 0.0), ("b", 1, 10, 0.0)], DDL)
    got = collected(series.aggregate_fixed_grid(df, ["s"], ["g"], "sum", 10))
    assert got == {None: [(5, 2.0)], "b": [(5, 0.0)]}


@pytest.mark.parametrize(
    "pts,interval,want",
    [
        ([(k, k) for k in range(6)], 1, [(k, k) for k in range(6)]),
        ([(k, k // 5) for k in range(25)], 5, [(2, 0), (7, 1), (12, 2), (17, 3), (22, 4)]),
        ([(100, 1), (200, 1), (350, 2), (500, 2)], 300, [(150, 1), (450, 2)]),
    ],
)
def test_downsample_cases(spark, pts, interval, want):
    assert collected(series.downsample(frame(spark, {"a": [pts]}), ["g", "s"], interval, "max"))["a"] == want


def test_downsample_against_the_definition(spark):
    groups = random_groups(3, 2, 4)
    got = {}
    for r in series.downsample(frame(spark, groups), ["g", "s"], 37, "avg").collect():
        got.setdefault((r.g, r.s), []).append((r.ts, r.value))
    for g, rows in groups.items():
        for s, pts in enumerate(rows):
            assert [tuple(x) for x in sorted(got[(g, s)])] == [(x, pytest.approx(y)) for x, y in slow_down(pts, F["avg"], 37)]


def test_rate(spark):
    rows = [[], [(1, 1)], [(k, 1) for k in range(11)], [(k, k) for k in range(11)], [(5, 1.0), (5, 2.0), (7, 6.0)]]
    got = {}
    for r in series.rate(frame(spark, {"a": rows}), ["g", "s"], order=["ts", "value"]).collect():
        got.setdefault(r.s, []).append((r.ts, r.value))
    assert sorted(got[2]) == [(k, 0.0) for k in range(1, 11)] and sorted(got[3]) == [(k, 1.0) for k in range(1, 11)]
    assert set(got) == {2, 3, 4} and got[4] == [(7, 2.0)]


def test_packing_round_trip_latest_and_repeats(spark):
    df = frame(spark, random_groups(4, 2, 3))
    back = series.unpack_rows(series.pack_rows(df, ["g", "s"], 100), ["g", "s"])
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
    one = frame(spark, {"a": [[(1, 5), (2, 5), (3, 6), (9, 5)]]})
    assert [tuple(r) for r in series.latest(one, ["g", "s"]).collect()] == [("a", 0, 4, 9, 5.0)]
    assert sorted((r.ts, r.value) for r in series.drop_repeats(one, ["g", "s"], chunk_s=2).collect()) == [(1, 5.0), (3, 6.0), (9, 5.0)]


def test_empty(spark):
    df = frame(spark, {})
    for out in (series.aggregate_union_grid(df, ["s"], ["g"], "max"), series.aggregate_fixed_grid(df, ["s"], ["g"], "max", 10), series.rate(df, ["g", "s"]), series.downsample(df, ["g", "s"], 5, "sum")):
        assert out.collect() == []
