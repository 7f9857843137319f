"""Queries of the text and training-data problems over the whole tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bitmaps, digests, packing, residue, tokens
from tidemark.model import tags_key
from tidemark.queries.problems import rounded, sql_rounded
from tidemark.session import table


SQL_TAGS_KEY = "array_to_string(list_sort(list_transform(map_entries(tags), lambda e: e.key || '=' || coalesce(e.value, ''))), ',')"
#: Certified rank error, as a share of n, that every group keeps (a half cluster and one value's rank).
RANK_BOUND = 0.01


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return digests.certified_percentiles(table(spark, d, "points"))


def p1_rank_check(spark: SparkSession, d: str) -> DataFrame:
    """Each group's number of values, and whether its certified rank error keeps the bound."""
    x = digests.certified_percentiles(table(spark, d, "points"))
    kept = F.col("rank_error") * F.col("n") <= RANK_BOUND * F.col("n") + 1
    return x.select(*digests.KEYS, "n", kept.alias("within_bound"))


def p1_small_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians of the groups of at most 100 values, whose digests hold every value: they must be exact."""
    x = digests.certified_percentiles(table(spark, d, "points"))
    return x.where("n <= 100").select(*digests.KEYS, "n", rounded(F.col("p50"), 3).alias("p50"))


def p5_distinct(spark: SparkSession, d: str) -> DataFrame:
    return bitmaps.distinct_cube(table(spark, d, "points"))


#: Groupings (4 day, 2 metric, 1 dc) in which the exact counts of p5_error_check are made, by entity.
CHECKED = {"metrics": range(8), "tag_names": range(8), "hosts": range(8), "traces": (0, 2), "sources": (0, 2)}


def p5_error_check(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct counts, and whether the estimate is within 5 standard errors: names, metrics and hosts in all groupings, the many traces and sources in two."""
    points = table(spark, d, "points")
    tags, by = F.col("tags"), F.col("by")
    items = {
        "metrics": F.array("metric"), "tag_names": F.map_keys(tags), "hosts": F.array(tags["host"]), "traces": F.array(tags["trace"]),
        "sources": F.array(F.when(F.col("metric").isNotNull(), F.concat("metric", F.lit(" "), tags_key()))),
    }

    def named(entity, values):
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(entity).alias("entity"), v.alias("v")))

    each = F.concat(*(named(*x) for x in items.items()))
    fine = points.select(F.floor(F.col("ts") / 86400).cast("int").alias("day"), "metric", tags["dc"].alias("dc"), F.explode(each).alias("e")).where("e.v is not null").select("day", "metric", "dc", "e.*").distinct()
    groupings = F.element_at(F.create_map(*(x for e, b in CHECKED.items() for x in (F.lit(e), F.array(*(F.lit(k) for k in b))))), F.col("entity"))
    keys = [F.when(by.bitwiseAND(b) > 0, F.col(c)).alias(c) for c, b in bitmaps.FLAGS]
    counted = fine.withColumn("by", F.explode(groupings)).select("entity", "by", *keys, "v").distinct().groupBy("entity", "by", "day", "metric", "dc").agg(F.count("*").alias("n_exact"))
    e = bitmaps.distinct_cube(points).select(
        F.col("entity").alias("kind"), (4 * F.col("by_day").cast("int") + 2 * F.col("by_metric").cast("int") + F.col("by_dc").cast("int")).alias("grouping"),
        *(F.col(c).alias(f"e_{c}") for c, _ in bitmaps.FLAGS), "n_distinct", "n_error",
    )
    same = (F.col("entity") == F.col("kind")) & (by == F.col("grouping"))
    for c, _ in bitmaps.FLAGS:
        same &= F.col(c).eqNullSafe(F.col(f"e_{c}"))
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 5 * F.col("n_error") + 1
    return counted.join(e, same).select("entity", "by", "day", "metric", "dc", "n_exact", near.alias("within_bound"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids; null becomes the empty text."""
    docs = table(spark, d, "documents")
    vocabulary = tokens.load_ranks(f"{tokens.VOCABULARIES}/{tokens.VOCABULARY}")
    return tokens.encode_texts(docs).select("doc_id", tokens.decode_ids("ids", vocabulary).alias("text"))


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(tokens.count_tokens(table(spark, d, "documents")), table(spark, d, "pack_sizes"))


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per container: documents assigned, bins beyond their capacity, texts split without need."""
    packs = table(spark, d, "pack_sizes")
    bins = p8_bins(spark, d).join(packs, "pack_name")
    fill = bins.groupBy("pack_name", "capacity", "bin_id").agg(F.sum("n_tokens").alias("fill"))
    docs = bins.groupBy("pack_name", "capacity", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("size"))
    over = fill.groupBy("pack_name").agg(F.sum((F.col("fill") > F.col("capacity")).cast("long")).alias("overfull_bins"))
    split = docs.groupBy("pack_name").agg(
        F.count("*").alias("n_docs"), F.sum(((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).cast("long")).alias("split_needlessly")
    )
    return split.join(over, "pack_name")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_summary(p8_bins(spark, d), table(spark, d, "pack_sizes"))


def p8_char_fill(spark: SparkSession, d: str) -> DataFrame:
    """The same packing by characters, which SQL can count: pieces, least number of bins, and whether at most 1 % more (and one) are used."""
    docs, packs = table(spark, d, "documents"), table(spark, d, "pack_sizes")
    sizes = docs.select("doc_id", F.length("text").alias("n_tokens"))
    s = packing.fill_summary(packing.pack_texts(sizes, packs), packs)
    return s.select("pack_name", "n_pieces", "least_bins", (F.col("n_bins") <= F.col("least_bins") * 1.01 + 1).alias("near_least"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.judge_texts(table(spark, d, "documents")).where("found").select("doc_id")


QUERIES = {f.__name__: f for f in (
    p1_percentiles, p1_rank_check, p1_small_medians, p5_distinct, p5_error_check, p7_ids, p7_round_trip, p8_bins, p8_audit, p8_fill, p8_char_fill, p9_found,
)}

_GROUPS = """
WITH r AS (SELECT metric, (ts // 86400)::INT AS day, tags['dc'] AS dc, tags['host'] AS host, tags['shard'] AS shard, tags['port'] AS port,
  float_value::DOUBLE AS f, coalesce(int_value::DOUBLE, float_value::DOUBLE) AS j FROM points WHERE metric IS NOT NULL AND ts IS NOT NULL),
d AS (SELECT metric, day, f, j, 'all' AS dim, NULL AS dim_value FROM r
  UNION ALL SELECT metric, day, f, j, 'dc', dc FROM r WHERE dc IS NOT NULL UNION ALL SELECT metric, day, f, j, 'host', host FROM r WHERE host IS NOT NULL
  UNION ALL SELECT metric, day, f, j, 'shard', shard FROM r WHERE shard IS NOT NULL UNION ALL SELECT metric, day, f, j, 'port', port FROM r WHERE port IS NOT NULL),
v AS (SELECT 'float' AS field, metric, dim, dim_value, day, f AS v FROM d UNION ALL SELECT 'joint', metric, dim, dim_value, day, j FROM d),
g AS (SELECT field, metric, dim, dim_value, day, v FROM v WHERE isfinite(v) UNION ALL SELECT field, metric, dim, dim_value, NULL, v FROM v WHERE isfinite(v))"""

SQL = {
    "p1_rank_check": _GROUPS + " SELECT field, metric, dim, dim_value, day, count(*) AS n, TRUE AS within_bound FROM g GROUP BY ALL",
    "p1_small_medians": _GROUPS + f" SELECT field, metric, dim, dim_value, day, count(*) AS n, {sql_rounded('quantile_cont(v, 0.5)', 3)} AS p50 FROM g GROUP BY field, metric, dim, dim_value, day HAVING count(*) <= 100",
    "p5_error_check": f"""
WITH k AS (SELECT (ts // 86400)::INT AS day, metric, tags['dc'] AS dc, map_keys(tags) AS names, tags['host'] AS host, tags['trace'] AS trace, CASE WHEN metric IS NOT NULL THEN metric || ' ' || {SQL_TAGS_KEY} END AS src FROM points),
x AS (SELECT day, metric, dc, 'metrics' AS entity, metric AS v FROM k UNION ALL SELECT day, metric, dc, 'tag_names', unnest(names) FROM k UNION ALL SELECT day, metric, dc, 'hosts', host FROM k
  UNION ALL SELECT day, metric, dc, 'traces', trace FROM k UNION ALL SELECT day, metric, dc, 'sources', src FROM k),
g AS (SELECT entity, grp, CASE WHEN grp & 4 > 0 THEN day END AS day, CASE WHEN grp & 2 > 0 THEN metric END AS metric, CASE WHEN grp & 1 > 0 THEN dc END AS dc, v
  FROM x, range(8) r(grp) WHERE v IS NOT NULL AND (entity NOT IN ('traces', 'sources') OR grp IN (0, 2)))
SELECT entity, grp::INT AS "by", day, metric, dc, count(DISTINCT v) AS n_exact, TRUE AS within_bound FROM g GROUP BY ALL""",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_audit": "SELECT pack_name, (SELECT count(*) FROM documents) AS n_docs, 0 AS overfull_bins, 0 AS split_needlessly FROM pack_sizes",
    "p8_char_fill": """
WITH p AS (SELECT pack_name, capacity, coalesce(length(text), 0) AS n FROM documents, pack_sizes)
SELECT pack_name, sum(greatest(1, ceil(n / capacity)))::BIGINT AS n_pieces, ceil(sum(n) / any_value(capacity))::BIGINT AS least_bins, TRUE AS near_least FROM p GROUP BY 1""",
}
