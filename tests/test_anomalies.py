import numpy as np

from tests.points import catalog, frame, gauge
from tidemark.operators.anomalies import chunk_kernel, flag_readings, judge

CATALOG = [{"metric": "m.x", "step_s": 60, "lowest": 0.0, "highest": 100.0}, {"metric": "m.free", "step_s": None, "lowest": 0.0, "highest": 1.0}]


def flags(spark, rows, extra="", **how):
    x = flag_readings(frame(spark, rows, extra), catalog(spark, CATALOG), **how)
    return {r.point_id: (r.impossible, r.spike, r.frozen) for r in x.collect()}


def noisy(n, seed=3):
    return [float(x) for x in 50 + np.random.default_rng(seed).normal(0, 1, n)]


def test_each_kind_of_case(spark):
    v = noisy(200)
    v[10], v[50] = 140.0, 75.0
    v[100:118] = [v[100]] * 18
    found = flags(spark, gauge(v))
    assert found[11][0] and found[51] == (False, True, False)
    assert {k for k, f in found.items() if f[2]} == set(range(101, 119))
    assert set(found) == {11, 51, *range(101, 119)}


def test_split_source_gives_the_same_as_a_whole_one(spark):
    v = noisy(900)
    v[299], v[300], v[640] = 80.0, 82.0, 20.0
    v[590:610] = [v[590]] * 20
    whole = flags(spark, gauge(v))
    assert whole == flags(spark, gauge(v), chunk_steps=100, halo_steps=80)
    assert {300, 301, 641} <= set(whole) and len(whole) == 23


def test_repeats_count_but_do_not_lengthen_runs(spark):
    v = noisy(60)
    rows = gauge(v)
    v6 = gauge(v)[5:6] * 12  # one reading delivered again and again
    assert flags(spark, rows + [r | {"point_id": 100 + k} for k, r in enumerate(v6)]) == {}
    v[30] = 90.0
    rows = gauge(v)
    found = flags(spark, rows + [rows[30] | {"point_id": 100}, rows[30] | {"point_id": 101, "float_value": v[29], "write_ms": None}])
    assert set(found) == {31, 100}


def test_nulls_other_metrics_clashing_columns_and_empty(spark):
    rows = gauge(noisy(40)) + [
        {"metric": None, "tags": {"a": "b"}, "ts": 1, "float_value": 500.0},
        {"metric": "m.x", "tags": None, "ts": 1, "float_value": 500.0},
        {"metric": "m.x", "tags": {"a": None}, "ts": 1, "float_value": 500.0},
        {"metric": "m.x", "tags": {"a": "b"}, "ts": 5, "float_value": None},
        {"metric": "m.free", "tags": {"a": "b"}, "ts": 1, "float_value": 500.0},
        {"metric": "m.x", "tags": {"n": "a"}, "ts": 1, "float_value": float("nan")},
        {"metric": "m.x", "tags": {}, "ts": 1, "int_value": 101},
    ]
    found = flags(spark, [r | {"value": 1, "chunk": 2, "key": "k"} for r in rows], "value INT, chunk INT, key STRING")
    assert set(found) == {43, 46, 47}
    assert flags(spark, []) == {}


def test_kernel_goes_on_within_a_huge_chunk(monkeypatch):
    import pyarrow as pa

    from tidemark.operators import anomalies

    monkeypatch.setattr(anomalies, "BUFFER_ROWS", 500)
    n = 5000
    v = 50 + np.random.default_rng(0).normal(0, 1, n)
    spikes = [700, 1500, 3333, 4999]
    v[spikes] += 30
    one = np.ones(n, np.int64)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (one, one, one, np.arange(n), v, np.zeros(n, bool), np.ones(n, bool), np.arange(n))], names=["a", "b", "chunk", "ts", "value", "bad", "core", "point_id"]
    )
    for group_rows in (1000, 10**6):  # in parts and as a whole
        out = list(chunk_kernel(5.5, 200, group_rows, {})(iter([batch.slice(k, 250) for k in range(0, n, 250)])))
        assert sorted(i for b in out for i in b.column(0).to_pylist()) == spikes


def test_judge_without_possible_rows():
    part = {"ts": np.array([1, 2]), "value": np.array([1e9, 1e9]), "bad": np.array([True, True]), "group": np.array([0, 0])}
    assert judge(part, 5.5, {}).tolist() == [[True, False, False]] * 2
