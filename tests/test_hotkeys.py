import math
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from tests.points import frame
from tidemark.operators.hotkeys import dense_totals, heavy_keys
from tidemark.queries import problems


def brute(rows):
    out = defaultdict(lambda: [0, 0, 0.0, None, None])
    for keys, v, at, tie in rows:
        for k in keys if isinstance(keys, list) else [keys]:
            o = out[k]
            o[0] += 1
            if v is not None:
                o[1] += 1
                o[2] += v
                order = (at if at is not None else -(10**18), tie)
                if o[3] is None or order > o[3]:
                    o[3], o[4] = order, v
    return {k: (o[0], o[1], o[2], o[4]) for k, o in out.items()}


@pytest.mark.parametrize("how", [{}, {"blocks": 3, "fan": 2, "most_keys": 2}])
@pytest.mark.parametrize("arrays", [False, True])
def test_totals_match_a_loop(spark, how, arrays):
    rows = [(f"k{min(i % 50, 6)}" if i % 11 else None, float(i % 7) if i % 5 else None, i % 9 if i % 13 else None, i) for i in range(2000)]
    if arrays:
        rows = [([k, "all"] if i % 3 else [], *r) for i, (k, *r) in enumerate(rows)]
    df = spark.createDataFrame(rows, f"key {'ARRAY<STRING>' if arrays else 'STRING'}, v DOUBLE, at INT, tie INT").repartition(5)
    got = {r.key: (r.n_rows, r.n_values, r.total, r.last_value) for r in dense_totals(df, "key", value="v", at="at", tie="tie", **how).collect()}
    assert got == brute(rows)


def test_counts_only_and_empty(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "key STRING")
    assert {(r.key, r.n_rows, r.n_values, r.last_value) for r in dense_totals(df, "key").collect()} == {("a", 2, 0, None), (None, 1, 0, None)}
    assert dense_totals(df.limit(0), "key").collect() == []
    assert dense_totals(df.limit(0), "key", value="key").collect() == []


def test_heavy_keys(spark):
    rows = [{"metric": "a" if i < 6 else f"m{i}", "tags": {"x": "1", "y": "2"} if i < 50 else ({"x": "1"} if i < 90 else None)} for i in range(99)] + [{"metric": None, "tags": {}}]
    assert {tuple(r) for r in heavy_keys(frame(spark, rows)).collect()} == {("metric", "a"), ("name", "x"), ("name", "y")}
    assert heavy_keys(frame(spark, [])).collect() == []


def test_sums_and_sources_of_all_keys(spark, small):
    points = pq.read_table(f"{small}/points.parquet", columns=["metric", "tags", "int_value", "float_value"]).to_pylist()
    by_metric, by_tag, sources = {}, {}, {}
    for p in points:
        v = p["float_value"] if p["int_value"] is None else float(p["int_value"])
        names = {k for k, _ in p["tags"] or []}
        for into, keys in ((by_metric, {p["metric"]} - {None}), (by_tag, names)):
            for k in keys:
                into.setdefault(k, []).extend([] if v is None else [v])
        if p["metric"] is not None and p["tags"] is not None:
            for k in names:
                sources.setdefault(k, set()).add((p["metric"], tuple(sorted((a, b or "") for a, b in p["tags"]))))
    for query, want in ((problems.p2_metric_sums, by_metric), (problems.p2_tag_sums, by_tag)):
        got = {r.key_name: r for r in query(spark, small).collect()}
        assert got.keys() == want.keys() and all(got[k].n_values == len(v) for k, v in want.items())
        assert all(got[k].total == (pytest.approx(math.fsum(v), rel=1e-9) if v else None) for k, v in want.items())
    assert {r.key_name: r.n_sources for r in problems.p2_tag_sources(spark, small).collect()} == {k: len(v) for k, v in sources.items()}


def test_nan_and_infinities_stay_in_the_sums(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("b", float("inf")), ("b", 2.0), ("c", None), ("c", 3.0), ("d", None)], "key STRING, v DOUBLE")
    got = {r.key: (r.n_values, r.total) for r in dense_totals(df, "key", value="v").collect()}
    assert math.isnan(got["a"][1]) and got["b"] == (2, math.inf) and got["c"] == (1, 3.0) and got["d"] == (0, 0.0)


def test_finished_blocks_are_handed_on(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(6000).selectExpr("cast(id % 1500 as string) as key", "cast(1 as double) as v").repartition(6)
        got = dense_totals(df, "key", value="v", blocks=40, most_keys=100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.key for r in got) == sorted(map(str, range(1500))) and {(r.n_rows, r.total) for r in got} == {(4, 4.0)}
