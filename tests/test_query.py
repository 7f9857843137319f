import json

import pytest

from tests.points import frame, gauge
from tidemark.operators import rollup, scan
from tidemark.operators.scan import AnyOf, One, Present
from tidemark.plans import planner
from tidemark.plans.query import Query, json_result, parse_request, parse_url, run, text_result

DAY = 86400


def test_filters():
    assert scan.parse_filter("*") == Present() and scan.parse_filter("a|b") == AnyOf(("a", "b")) and scan.parse_filter("a") == One("a")
    assert scan.parse_arrow_filters("a->*;b->x y;c->z") == {"a": Present(), "b": AnyOf(("x", "y")), "c": One("z")}
    assert scan.parse_fixed_tags("a x,b y") == {"a": "x", "b": "y"}
    assert scan.shard_names({"cluster": AnyOf(("a", "b")), "x": One("y")}, ("cluster",)) == ["cluster=a", "cluster=b"]
    for bad in (lambda: scan.parse_filter("|"), lambda: scan.parse_arrow_filters("a"), lambda: scan.parse_fixed_tags("a"), lambda: scan.shard_names({}, ("cluster",)), lambda: scan.shard_names({"cluster": Present()}, ("cluster",))):
        with pytest.raises(ValueError):
            bad()


def rows(spark):
    data = []
    for host, base in (("a", 0), ("b", 100), ("c", 50)):
        data += gauge([base + k for k in range(5)], tags={"host": host, "cluster": "c1" if host != "c" else "c2"}, start=600, step=60, kind="int_value")
    return frame(spark, data)


def answered(spark, **q):
    out = run(rows(spark), Query("m.x", start=0, stop=10_000, **q))
    return sorted((tuple(sorted(r.group_tags.items())), r.ts, r.value) for r in out.collect())


def test_request_steps(spark):
    assert answered(spark, aggregate="sum", filters={"cluster": One("c1")})[0] == ((), 600, 100.0)
    assert {g for g, *_ in answered(spark, aggregate="max", filters={"host": AnyOf(("a", "c", "zz"))})} == {(("host", "a"),), (("host", "c"),)}
    assert len({g for g, *_ in answered(spark, aggregate="max", filters={"host": Present(), "cluster": One("c1")})}) == 2
    assert answered(spark, aggregate="avg", rate=True) == [((), 660 + 60 * k, pytest.approx(1 / 60)) for k in range(4)]
    assert answered(spark, aggregate="max", interval=120, downsampler="max") == [((), 660, 101.0), ((), 780, 103.0), ((), 900, 104.0)]
    # the rate is taken of bucket centres
    assert answered(spark, aggregate="max", interval=120, downsampler="max", rate=True) == [((), 780, pytest.approx(2 / 120)), ((), 900, pytest.approx(1 / 120))]
    assert run(rows(spark), Query("no.such", "sum", 0, 10)).collect() == []
    with pytest.raises(ValueError):
        run(rows(spark), Query("no.such", "sum", 0, 10), strict=True)
    with pytest.raises(ValueError):
        Query("m", "median", 0, 10)


def test_half_open_range_and_last_write(spark):
    data = gauge([1.0, 2.0, 3.0], start=0, step=10) + gauge([9.0], start=10, write_ms=10**9) + gauge([7.0], start=10, write_ms=None)
    got = scan.scan(frame(spark, data), "m.x", 0, 20).collect()
    assert sorted((r.ts, r.value) for r in got) == [(0, 1.0), (10, 9.0)]
    both = gauge([1.0], start=0) + gauge([2], start=0, kind="int_value")
    assert scan.last_write(frame(spark, both)).count() == 2


def test_tag_order_does_not_matter(spark):
    data = [{"metric": "m", "tags": dict(t), "ts": 5, "int_value": v, "write_ms": v} for v, t in ((1, [("a", "1"), ("b", "2")]), (2, [("b", "2"), ("a", "1")]))]
    got = scan.last_write(frame(spark, data)).collect()
    assert [(r.tags_key, r.value) for r in got] == [("a=1,b=2", 2.0)]


def test_parsing():
    body = {"start": 1000, "end": 9_000_999, "queries": [{"metric": "m", "aggregator": "sum", "tags": {"h": "a|b"}, "downsample": "10m-avg", "rate": True}]}
    assert parse_request(json.dumps(body)) == [Query("m", "sum", 1, 9000, {"h": AnyOf(("a", "b"))}, 600, "avg", True)]
    assert parse_url("m", {"start": "5", "end": "9", "attrs": "h->*", "agrg": "min", "dsagrg": "max", "dsint": "60"}) == Query("m", "min", 5, 9, {"h": Present()}, 60, "max")
    with pytest.raises(ValueError):
        parse_request(body | {"queries": [{"metric": "m", "aggregator": "sum", "downsample": "10m"}]})


def test_results(spark):
    out = run(rows(spark), Query("m.x", "max", 0, 10_000, {"host": Present()}))
    got = {json.loads(r.json)["tags"]["host"]: json.loads(r.json) for r in json_result(out).collect()}
    assert got["a"] == {"metric": "m.x", "tags": {"host": "a"}, "dps": {str(600 + 60 * k): float(k) for k in range(5)}}
    assert {(r.group, r.ord, r.line) for r in text_result(out).where("ord < 601").collect()} >= {("host=a", -1, "host=a"), ("host=a", 600, "600 0.0")}


def test_candidates():
    assert [planner.candidates(i) for i in (None, 60, 300, 7200, 10**7)] == [[None], [None], ["5m", None], ["hour", "5m", None], ["day", "hour", "5m", None]]


@pytest.mark.parametrize(
    "hour,five,raw,stop,interval,want",
    [
        ([], [], [(0, 1), (1, 1)], 2, None, [(0, 1), (1, 1)]),
        ([], [(0, 1), (300, 1)], [], 400, 300, [(150, 1), (450, 1)]),
        ([], [(0, 1)], [(450, 2)], 600, 300, [(150, 1), (450, 2)]),
        ([], [], [(150, 1), (450, 2)], 600, 300, [(150, 1), (450, 2)]),
        ([(0, 1)], [], [(1800, 1), (5400, 2)], 7200, 3600, [(1800, 1), (5400, 2)]),
    ],
)
def test_stitching_cases(spark, hour, five, raw, stop, interval, want):
    stored = {"hour": hour, "5m": five, "day": [], None: raw}

    def fetch(resolution, a, b):
        return spark.createDataFrame([("s", t, float(v)) for t, v in stored[resolution] if a <= t < b], "k STRING, ts INT, value DOUBLE")

    assert sorted((r.ts, r.value) for r in planner.stitched(fetch, 0, stop, interval, "max", ["k"]).collect()) == want


def test_roll_up(spark):
    df = spark.createDataFrame([("m", "k", k * 60, float(k // 60)) for k in range(3600)], "metric STRING, tags_key STRING, ts INT, value DOUBLE")
    got = sorted((r.ts, r.value) for r in rollup.roll_up(df, "hour").where("agg = 'avg'").collect())
    assert got == [(h * 3600, float(h)) for h in range(60)]
    days = rollup.day_from_hours(rollup.roll_up(df, "hour"))
    assert sorted((r.ts, r.agg, r.value) for r in days.where("ts = 0").collect()) == [(0, "avg", 11.5), (0, "max", 23.0), (0, "min", 0.0), (0, "sum", 60.0 * sum(range(24)))]


def test_roll_up_job_replaces_its_days_only(spark, tmp_path):
    df = spark.createDataFrame([("m", "k", k * 600, float(k)) for k in range(432)], "metric STRING, tags_key STRING, ts INT, value DOUBLE")
    path = str(tmp_path / "r")
    rollup.roll_up_job(df, 0, 3 * DAY, "hour", path)
    before = spark.read.parquet(path).count()
    rollup.roll_up_job(df.withColumn("value", df.value + 1000), DAY, 2 * DAY, "hour", path)
    after = spark.read.parquet(path)
    assert after.count() == before
    assert {(r.ts // DAY, r.value >= 1000) for r in after.where("agg = 'min' and resolution = 'hour'").collect()} == {(0, False), (1, True), (2, False)}
    for bad in ((0, 100, "hour"), (0, 0, "hour"), (3600, 7200, "day"), (0, DAY, "week")):
        with pytest.raises(ValueError):
            rollup.roll_up_job(df, *bad)


def test_request_served_from_rollups(spark):
    points = frame(spark, gauge([float(k) for k in range(240)], start=0, step=60))
    written = scan.last_write(points)
    stored = rollup.roll_up(written.where("ts < 7200"), "hour").join(written.select("tags_key", "tags").dropDuplicates(["tags_key"]), "tags_key")
    q = Query("m.x", "sum", 0, 14_400, {}, 3600, "max")
    assert sorted((r.ts, r.value) for r in run(points, q, stored).collect()) == sorted((r.ts, r.value) for r in run(points, q).collect())


def test_registered_aggregate_and_same_rows(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import series

    series.register_aggregate("range", lambda c: F.max(c) - F.min(c))
    try:
        assert {v for *_, v in answered(spark, aggregate="range")} == {100.0}
    finally:
        del series.AGGREGATES["range"]
    df = spark.createDataFrame([(1,), (1,), (2,)], "a INT")
    assert scan.same_rows(df, df.orderBy("a")) and not scan.same_rows(df, df.distinct())


def test_tagged_actions(spark):
    from tidemark.session import cancel, run_tagged

    assert run_tagged(spark, "t1", lambda: spark.range(5).count()) == 5
    assert cancel(spark, "t1") == []
