import pytest

from tidemark.functions import times


def test_durations():
    assert [times.parse_duration(t) for t in ("5s", "10m", "1h", "2d", "1w", "1y")] == [5, 600, 3600, 172800, 604800, 31536000]
    for bad in ("", "m", "10", "0m", "-1m", "1x", "1.5h"):
        with pytest.raises(ValueError):
            times.parse_duration(bad)


def test_buckets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in (0, 299, 300, 450)], "ts INT")
    assert [tuple(r) for r in df.select(times.bucket_start("ts", 300), times.bucket_centre("ts", 300)).collect()] == [(0, 150), (0, 150), (300, 450), (300, 450)]
    assert df.select(times.bucket_centre(F.col("ts"), 5)).first()[0] == 2


def test_generations(spark):
    span = times.SPAN_S
    config = times.periods([("01/01/24", 2), ("01/06/24", 1)])
    assert [p.spans for p in config] == [2, 1] and config[0].start % span == 0 and config[1].first > 0
    a, b = config
    now = b.start + 10
    df = spark.createDataFrame([(t,) for t in (a.start - 1, a.start, a.start + 2 * span, b.start - 1, b.start, b.start + span, now + span)], "ts INT")
    got = [r[0] for r in df.select(times.generation("ts", config, now)).collect()]
    assert got[:3] == [-1, 0, 1] and got[3] == b.first - 1 and got[4:] == [b.first, b.first + 1, -1]
    ranges = times.generation_ranges(config, a.start + 5, b.start + 5)
    assert ranges[0][0] == a.start + 5 and ranges[-1] == (b.start, b.start + 5, b.first)
    assert all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    assert times.recent_generations(config, now) == [b.first, b.first - 1, b.first - 2]
    assert times.recent_generations(config, 0) == []


def test_far_future_is_outside(spark):
    config = times.periods([("01/01/70", 1)])
    df = spark.createDataFrame([(28 * 86400,)], "ts INT")
    assert df.select(times.generation("ts", config, 0)).first()[0] == -1
