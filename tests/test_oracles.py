import pytest

from tests.compare import compare, duck
from tidemark.queries import problems, storage, timeseries

ALL = {**timeseries.QUERIES, **storage.QUERIES, **problems.QUERIES}
SQL = {**timeseries.SQL, **storage.SQL, **problems.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, small, name):
    ok, what = compare(spark, duck(small), small, ALL[name], SQL[name])
    assert ok, what


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["p2_metric_sums", "p2_tag_sums"])
def test_sums_against_a_loop(spark, small, name):
    import math
    from collections import defaultdict

    want = defaultdict(list)
    for r in spark.read.parquet(f"{small}/points.parquet").select("metric", "tags", "int_value", "float_value").collect():
        v = r.int_value if r.int_value is not None else r.float_value
        for k in [r.metric] if name == "p2_metric_sums" else list(r.tags or {}):
            want[k] += [] if v is None else [float(v)]
    want.pop(None, None)
    got = {r.key_name: (r.n_values, r.total) for r in ALL[name](spark, small).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == len(v) and (got[k][1] == pytest.approx(math.fsum(v)) if v else got[k][1] is None) for k, v in want.items())


def test_flagged_readings_are_of_judged_sources(spark, small):
    found = ALL["p3_found"](spark, small)
    points, catalog = spark.read.parquet(f"{small}/points.parquet"), spark.read.parquet(f"{small}/metric_catalog.parquet")
    judged = points.join(catalog.where("step_s > 0"), "metric", "left_semi").where("tags is not null and (int_value is not null or float_value is not null)")
    assert found.count() == found.distinct().count() > 0 and found.join(judged, "point_id", "left_anti").count() == 0
    assert found.join(ALL["p3_impossible"](spark, small), "point_id").count() == ALL["p3_impossible"](spark, small).count()
