import gzip
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.points import frame, gauge
from tidemark.functions.times import periods
from tidemark.operators import health, names
from tidemark.operators.scan import last_write
from tidemark.sinks import store
from tidemark.sources import packs, readers
from tidemark.streaming import ingest

POINTS = [
    {"metric": "m", "ts": 5, "tags": {"a": "b", "ü": "ß"}, "value_type": "INT", "int_value": -7, "float_value": None, "int_list": None, "float_list": None},
    {"metric": "m", "ts": 2**31 - 1, "tags": {}, "value_type": "FLOAT", "int_value": None, "float_value": 1.5, "int_list": None, "float_list": None},
    {"metric": "m", "ts": 0, "tags": {"a": "b"}, "value_type": "INT_LIST", "int_value": None, "float_value": None, "int_list": [1, -(2**63), 3], "float_list": None},
    {"metric": "m", "ts": 1, "tags": {"a": "b"}, "value_type": "FLOAT_LIST", "int_value": None, "float_value": None, "int_list": None, "float_list": [0.5, -2.0]},
]


def test_packs_round_trip():
    assert packs.decode_pack(packs.encode_pack(POINTS)) == (None, POINTS)
    assert packs.decode_pack(packs.encode_pack(POINTS, 42), with_batch_id=True) == (42, POINTS)
    assert packs.decode_pack(b"") == (None, [])


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 200))
def test_corrupt_packs_raise_value_errors_only(noise, at):
    data = packs.encode_pack(POINTS)
    broken = data[:at] + noise + data[at + 3 :]
    try:
        packs.decode_pack(broken)
    except (ValueError, KeyError, IndexError, UnicodeDecodeError):
        pass
    except Exception as e:  # struct.error is caught by the operator
        assert type(e).__name__ == "error"


def snap(data):
    """Literal-only and one back reference, by the block format."""
    out = packs.put_varint(len(data))
    for k in range(0, len(data), 60):
        part = data[k : k + 60]
        out += bytes([(len(part) - 1) << 2]) + part
    return out


def snap_frames(data, plain):
    crc = lambda b: packs.masked_crc(b).to_bytes(4, "little")
    parts = ((0, crc(data) + snap(data)), (1, crc(plain) + plain))
    return b"\xff\x06\x00\x00sNaPpY" + b"".join(bytes([kind]) + len(b).to_bytes(3, "little") + b for kind, b in parts)


def test_streams_are_read_to_their_end():
    one, two = zlib.compress(b"first" * 300), gzip.compress(b"second")
    assert packs.inflate_all(one + two) == b"first" * 300 + b"second"
    for cut in (one[:-5], one[: len(one) // 2], one + two[:-9], one + b"junk"):
        with pytest.raises(ValueError):
            packs.inflate_all(cut)
    with pytest.raises(ValueError):
        packs.inflate_all(one + two, most=1503)


def test_frames_in_a_line_stream(spark, tmp_path):
    t = "put a {} 1 cluster=c\n"
    first, second = (t.format(2) + t.format(3)[:9]).encode(), (t.format(3)[9:] + t.format(4)).encode()
    z, sn = zlib.compress(first), snap_frames(second, b"")
    data = t.format(1).encode() + b"deflate %d\n" % len(z) + z + b"snappy %d\n" % len(sn) + sn + t.format(5).encode() + b"deflate 3\nxyz" + t.format(6).encode() + b"deflate 99\nab"
    folder = tmp_path / "streams"
    folder.mkdir()
    (folder / "a").write_bytes(data)
    (folder / "b").write_bytes(t.format(7).encode()[:-1])
    (folder / "c").write_bytes(b"")
    got = readers.read_line_streams(spark, str(folder)).collect()
    assert sorted(r.ts for r in got if r.error is None) == [1, 2, 3, 4, 5, 6, 7]
    assert sorted(r.error for r in got if r.error is not None) == ["truncated frame", "truncated stream"]


def test_compressed_frames():
    data = b"abcabcabc" * 40
    assert packs.inflate(zlib.compress(data) + b"rest") == (data, b"rest")
    assert packs.inflate(gzip.compress(data))[0] == data
    raw = zlib.compressobj(wbits=-15)
    assert packs.inflate(raw.compress(data) + raw.flush())[0] == data
    with pytest.raises(ValueError):
        packs.inflate(zlib.compress(data), most=10)
    assert packs.unsnap(snap(data)) == data
    assert packs.unsnap(b"\x09" + bytes([2 << 2]) + b"abc" + bytes([(6 - 4) << 2 | 1, 3])) == b"abcabcabc"
    frames = snap_frames(data, b"plain")
    assert packs.unsnap_frames(frames) == data + b"plain"
    assert packs.masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    for bad in (b"\x02\x01\x00\x00x", b"\x00\xff", b"\x00\x06\x00\x00crc!\x05\x01", frames[:-1] + b"X", frames[:14] + b"!" + frames[15:]):
        with pytest.raises((ValueError, IndexError)):
            packs.unsnap_frames(bad)


def test_pack_operator(spark):
    good = packs.encode_pack(POINTS, 9)
    df = spark.createDataFrame([(bytearray(x),) if x is not None else (None,) for x in (good, b"\x01\x02", None, good[:-1])], "value BINARY")
    got = packs.decode_packs(df).collect()
    assert sum(r.error is None for r in got) == 4 and sum(r.error is not None for r in got) == 2
    assert {r.batch_id for r in got if r.error is None} == {9}
    zipped = spark.createDataFrame([(bytearray(zlib.compress(good)),)], "value BINARY")
    assert packs.decode_packs(zipped, compression="deflate").count() == 4
    back = packs.encode_packs(packs.decode_packs(df).where("error is null"))
    assert packs.decode_packs(back).count() == 4


def test_kafka_options():
    ranges = readers.parse_ranges("t,0,5,9;t,1,0,3;u,0,1,2")
    assert readers.kafka_reads(ranges) == [('{"t": [0, 1], "u": [0]}', '{"t": {"0": 5, "1": 0}, "u": {"0": 1}}', '{"t": {"0": 9, "1": 3}, "u": {"0": 2}}')]
    two = readers.kafka_reads(readers.parse_ranges("t,0,20,30;t,0,5,9;t,0,8,12;t,1,4,4;t,2,0,1"))
    assert two == [('{"t": [0, 2]}', '{"t": {"0": 5, "2": 0}}', '{"t": {"0": 12, "2": 1}}'), ('{"t": [0]}', '{"t": {"0": 20}}', '{"t": {"0": 30}}')]
    assert readers.kafka_reads([]) == []


def test_generators(spark):
    x = readers.sine_points(spark, start=0, stop=1000, step=100, periods=[1000, 2000], amps=[10], shifts=[500, 1000])
    assert x.count() == 40 and x.where("abs(float_value) > 10").count() == 0
    from tidemark.functions.lines import parse_lines

    assert parse_lines(readers.generated_lines(spark, 50)).where("error is null").count() == 50


CONFIG, NOW = periods([("01/03/24", 1)]), 1_709_300_000


def test_store_prunes_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "points")
    start = CONFIG[0].start + 100
    rows = gauge([1.0, 2.0], start=start, tags={"cluster": "c1"}) + gauge([5.0], start=start, tags={"cluster": "c2"}) + gauge([7.0], start=100, tags={"cluster": "c1"})
    laid = store.with_layout(frame(spark, rows).drop("point_id", "batch_id"), config=CONFIG, now=NOW)
    store.write_points(laid, path)
    store.write_points(store.with_layout(frame(spark, gauge([9.0], start=start, tags={"cluster": "c1"}, write_ms=10**14)).drop("point_id", "batch_id"), config=CONFIG, now=NOW), path)
    everything = readers.read_points(spark, path)
    assert everything.count() == 4  # the point of 1970 is outside all generations
    one = readers.read_points(spark, path, start=start, stop=start + 1, config=CONFIG, shards=["cluster=c1"])
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1][:200]
    assert [r.value for r in last_write(one, tie=None).collect()] == [9.0]
    store.compact(spark.read.parquet(path), str(tmp_path / "compacted"))
    assert spark.read.parquet(str(tmp_path / "compacted")).count() == 4


def test_compaction_keeps_kinds_of_values_and_other_partitions(spark, tmp_path):
    path, start = str(tmp_path / "t"), CONFIG[0].start + 5
    kinds = [{"int_value": 1}, {"float_value": 1.5}, {"int_list": [1]}, {"float_list": [0.5]}, {"int_value": 2}]
    rows = [{"metric": "m", "tags": {"cluster": "c"}, "ts": start, "write_ms": k, **v} for k, v in enumerate(kinds)]
    lay = lambda r: store.with_layout(frame(spark, r).drop("point_id", "batch_id"), config=CONFIG, now=NOW)
    store.compact(lay(rows + gauge([1.0], start=100, tags={"cluster": "c"})), path)
    assert spark.read.parquet(path).count() == 5
    store.compact(readers.read_points(spark, path), path + "2")
    assert spark.read.parquet(path + "2").count() == 4  # what lies outside the generations was not read
    store.compact(lay(gauge([9.0], start=100, tags={"cluster": "c"})), path + "2")
    got = spark.read.parquet(path + "2")
    assert got.count() == 5 and {r.int_value for r in got.where("int_value is not null").collect()} == {2}


def test_of_two_lines_for_one_point_the_later_wins(spark, tmp_path):
    src = lines_dir(tmp_path, "".join(f"put a 5 {k} cluster=c\n" for k in range(40)))
    out = str(tmp_path / "out")
    sink = store.points_sink(out, config=CONFIG, now=lambda: NOW)
    ingest.ingest_lines(readers.read_lines(spark, src, streaming=True), sink, None, str(tmp_path / "check"), clock=lambda: 7).awaitTermination()
    stored = spark.read.parquet(out)
    assert [r.value for r in last_write(stored, tie=None).collect()] == [39.0]
    store.compact(stored, str(tmp_path / "compacted"))
    assert [r.int_value for r in spark.read.parquet(str(tmp_path / "compacted")).collect()] == [39]


def lines_dir(tmp_path, *texts):
    folder = tmp_path / "lines"
    folder.mkdir(exist_ok=True)
    for text in texts:
        (folder / f"{len(list(folder.iterdir()))}.txt").write_text(text)
    return str(folder)


def test_stream_upserts_and_survives_replay(spark, tmp_path):
    t = CONFIG[0].start + 1000
    src = lines_dir(tmp_path, f"put a {t} 1 cluster=c\nput a {t + 60} 2 cluster=c\nbroken\n")
    out, dead, check = (str(tmp_path / n) for n in ("out", "dead", "check"))
    clock = [1]
    sink = store.points_sink(out, config=CONFIG, now=lambda: NOW)
    go = lambda s, c: ingest.ingest_lines(readers.read_lines(spark, src, streaming=True), s, store.parquet_sink(dead), c, clock=lambda: clock[0]).awaitTermination()
    go(sink, check)
    lines_dir(tmp_path, f"put a {t} 5 cluster=c\n")
    clock[0] = 2
    go(sink, check)
    go(sink, check)
    stored = spark.read.parquet(out)
    assert stored.count() == 3 and spark.read.parquet(dead).count() == 1
    assert sorted((r.ts, r.value) for r in last_write(stored, tie=None).collect()) == [(t, 5.0), (t + 60, 2.0)]
    # the same batch number again replaces what it wrote
    sink(stored.where("batch = 0").drop("batch", "gen", "shard"), 0)
    assert spark.read.parquet(out).count() == 3


def test_stream_failover_and_fan_out(spark, tmp_path):
    from pyspark.sql import functions as F

    src = lines_dir(tmp_path, "put a 5 1 cluster=c\nput b 5 2 cluster=c\n")
    a, b, c, d = (str(tmp_path / n) for n in "abcd")
    safe = store.failover(store.failing, store.parquet_sink(a))
    split = store.failover(store.parquet_sink(b), store.parquet_sink(c), drop_where=F.col("metric") == "b")
    ingest.ingest_lines(readers.read_lines(spark, src, streaming=True), store.fan_out(safe, split, store.parquet_sink(d), store.blackhole), None, str(tmp_path / "check")).awaitTermination()
    assert [spark.read.parquet(p).count() for p in (a, b, c, d)] == [2, 1, 1, 2]


def test_rolling_takes_late_points(spark, tmp_path):
    src = lines_dir(tmp_path, "put a 86400 1 cluster=c\nput a 86460 3 cluster=c\n")
    out, roll = str(tmp_path / "out"), str(tmp_path / "roll")
    run = lambda: (
        ingest.ingest_lines(readers.read_lines(spark, src, streaming=True), store.parquet_sink(out), None, str(tmp_path / "c1"), clock=lambda: 1).awaitTermination(),
        ingest.rolling(spark.readStream.schema(spark.read.parquet(out + "/batch=0").schema).parquet(out + "/*"), roll, str(tmp_path / "c2"), store=lambda: spark.read.parquet(out)).awaitTermination(),
    )
    run()
    lines_dir(tmp_path, "put a 86401 8 cluster=c\n")
    run()
    assert [r.value for r in spark.read.parquet(roll).where("agg = 'max'").collect()] == [8.0]


def test_names_and_health(spark):
    rows = [{"metric": m, "tags": {"host": h, "zone": "z"}, "ts": t, "int_value": 1} for m, h, t in [("cpu", f"h{k}", 70 + k % 10) for k in range(10)] + [("cpu", f"h{k}", 80 + k % 10) for k in range(11)] + [("mem", "h1", 5)]]
    df = frame(spark, rows)
    table = names.name_table(df)
    assert [r.name for r in names.suggest(table, "metrics", "", 1).collect()] == ["cpu"]
    assert [r.name for r in names.suggest(table, "tagk", "z").collect()] == ["zone"]
    assert [r.name for r in names.suggest(table, "tagv", "h1", per_generation=False).collect()] == ["h1", "h10"]
    with pytest.raises(ValueError):
        names.suggest(table, "hosts", "")
    assert names.resolve(df.select("metric").distinct(), names.number_names(table), "metric", "metric").count() == 2
    good = health.health_check(df, "cpu", "host", 100, 10).first()
    assert (good.n_before, good.n_after, good.healthy) == (10, 11, True)
    assert health.health_check(df, "cpu", "host", 100, 10, {"zone": "y"}).first().healthy is None
    assert health.distinct_values(df, "cpu", "host", 80, 90).first()[0] == 11


def test_dictionary_of_names(spark, tmp_path):
    rows = spark.createDataFrame([("value", k % 2, f"n{k:04d}") for k in range(3000)] + [("metric", 0, "m"), ("metric", 0, "m")], "kind STRING, gen INT, name STRING")
    got = {(r.kind, r.gen, r.name): r.id for r in names.number_names(rows.repartition(7)).collect()}
    assert len(got) == 3001 and got["metric", 0, "m"] == 1
    assert all(got["value", k % 2, f"n{k:04d}"] == k // 2 + 1 for k in range(3000))
    path = str(tmp_path / "names")
    names.store_names(rows.where("name < 'n2000'"), path)
    names.store_names(rows, path)
    names.store_names(rows, path)
    assert spark.read.parquet(path).count() == 3001
    assert [r.name for r in names.suggest(spark.read.parquet(path), "tagv", "n00", 2, [1]).collect()] == ["n0001", "n0003"]


def test_queue_lag(spark):
    df = spark.createDataFrame([(1, "t", 0, 10, 5), (2, "t", 0, 12, 6), (2, "t", 0, 12, 6), (1, "t", 1, 7, None)], "sample_ms BIGINT, topic STRING, partition_id INT, latest BIGINT, consumed BIGINT")
    lag = health.queue_lag(df)
    assert {tuple(r) for r in lag.collect()} == {("t", 0, 12, 6, 6), ("t", 1, 7, None, 7)}
    assert [tuple(r) for r in health.lag_summary(lag).collect()] == [("t", 13, 7)]
