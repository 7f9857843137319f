import pytest
from pyspark.sql import functions as F

from tests.compare import compare, duck
from tidemark.llm import digests
from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, small, name):
    ok, what = compare(spark, duck(small), small, QUERIES[name], SQL[name])
    assert ok, what


def test_percentiles_are_in_order_and_certified(spark, small):
    x = QUERIES["p1_percentiles"](spark, small)
    names = [digests.percent_name(q) for q in digests.QUANTILES]
    assert x.where("dim = 'all' and day is null").count() > 5
    for a, b in zip(names, names[1:]):
        assert x.where(F.col(a) > F.col(b)).count() == 0
    assert x.where("rank_error is null or rank_error * n > 0.01 * n + 1").count() == 0


def test_distinct_counts_of_small_groups_are_near(spark, small):
    x = QUERIES["p5_distinct"](spark, small)
    metrics = spark.read.parquet(f"{small}/points.parquet").select("metric").distinct().where("metric is not null").count()
    got = x.where("entity = 'metrics' and not by_day and not by_metric and not by_dc").first()
    assert abs(got.n_distinct - metrics) <= 4 * got.n_error + 1
    assert x.where("n_distinct is null or n_distinct < 1 or n_error > 0.02 * n_distinct + 1").count() == 0


def test_ids_for_every_document(spark, small):
    x = QUERIES["p7_ids"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), "doc_id")
    assert x.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    assert x.where("(coalesce(text, '') = '') != (size(ids) = 0)").count() == 0


def test_bins_hold_every_document_once(spark, small):
    bins = QUERIES["p8_bins"](spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    assert {r.n for r in bins.groupBy("pack_name").agg(F.countDistinct("doc_id").alias("n")).collect()} == {docs}
    assert bins.groupBy("pack_name", "doc_id", "piece").count().where("count > 1").count() == 0
    fill = QUERIES["p8_fill"](spark, small).collect()
    assert len(fill) == 3 and all(r.least_bins <= r.n_bins <= r.least_bins * 1.01 + 1 and 0 < r.used_share <= 1 for r in fill)


def test_found_residue_is_of_the_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = QUERIES["p9_found"](spark, small)
    assert found.count() == found.distinct().count() and 0 < found.count() < docs.count() / 4
    assert found.join(docs.where("coalesce(trim(text), '') = ''"), "doc_id").count() == 0
