"""Queries of the general data problems (2, 3, 4 and 6) over the whole tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import scalar_value, series_key
from tidemark.operators import anomalies, grid, hotkeys, ledger
from tidemark.session import shared_folder, table, written

#: ``metric{name=value,...}`` of a row of points, in DuckDB's SQL
SQL_KEY = (
    "metric || '{' || array_to_string(list_sort(list_transform(map_entries(tags), "
    "lambda e: e.key || '=' || coalesce(e.value, ''))), ',') || '}'"
)
SQL_VALUE = "coalesce(int_value::DOUBLE, float_value::DOUBLE)"


def rounded(c, digits: int = 4):
    """Both engines round alike: ties of sums in another order are moved off the edge."""
    return F.floor(c * 10**digits + 0.50001) / 10**digits


def sql_rounded(c: str, digits: int = 4) -> str:
    return f"floor(({c}) * {10**digits} + 0.50001) / {10**digits}"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_keys(table(spark, d, "points"))


def _totals(points: DataFrame, key) -> DataFrame:
    x = points.select(key.alias("key"), scalar_value().alias("value"), "ts", "point_id")
    totals = hotkeys.dense_totals(x, "key", value="value", at="ts", tie="point_id")
    mean = F.try_divide(F.col("total"), F.col("n_values"))
    return totals.where(F.col("key").isNotNull()).select(
        F.col("key").alias("key_name"), "n_rows", "n_values", rounded(mean).alias("mean_value"), rounded(F.col("last_value")).alias("last_value")
    )


def p2_metric_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(table(spark, d, "points"), F.col("metric"))


def p2_tag_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(table(spark, d, "points"), F.map_keys("tags"))


def p2_metric_sources(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sources per metric: pairs are made distinct before they are counted, so no metric is long."""
    points = table(spark, d, "points")
    pairs = points.select("metric", series_key().alias("k")).where("k is not null").distinct()
    return hotkeys.dense_totals(pairs, "metric").select(F.col("key").alias("key_name"), F.col("n_rows").alias("n_sources"))


def p2_tag_sources(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sources per tag name: one row per source first, so no name is long."""
    sources = table(spark, d, "points").select(series_key().alias("k"), F.array_sort(F.map_keys("tags")).alias("names")).where("k is not null").distinct()
    return hotkeys.dense_totals(sources, "names").select(F.col("key").alias("key_name"), F.col("n_rows").alias("n_sources"))


def _sums(points: DataFrame, key) -> DataFrame:
    totals = hotkeys.dense_totals(points.select(key.alias("key"), scalar_value().alias("value")), "key", value="value")
    return totals.where(F.col("key").isNotNull()).select(F.col("key").alias("key_name"), "n_values", F.when(F.col("n_values") > 0, F.col("total")).alias("total"))


def p2_metric_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums per metric; without SQL, as the last digits of a sum depend on its order."""
    return _sums(table(spark, d, "points"), F.col("metric"))


def p2_tag_sums(spark: SparkSession, d: str) -> DataFrame:
    return _sums(table(spark, d, "points"), F.map_keys("tags"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.flag_readings(table(spark, d, "points"), table(spark, d, "metric_catalog")).select("point_id")


def p3_impossible(spark: SparkSession, d: str) -> DataFrame:
    flags = anomalies.flag_readings(table(spark, d, "points"), table(spark, d, "metric_catalog"))
    return flags.where("impossible").select("point_id")


LEASE_MS = 600_000


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The next run by the ledger, at a time when all leases of the log have expired; a ledger of its own for each call."""
    messages, log = table(spark, d, "queue_messages"), table(spark, d, "kafka_inputs")
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    now = (log.agg(F.max("logged_ms")).first()[0] or 0) + LEASE_MS + 1
    book = ledger.WorkLedger(spark, f"{folder}/states", lease_ms=LEASE_MS)
    return ledger.load_next(book, f"{folder}/output", messages, log, now_ms=now, lease_ms=LEASE_MS)


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    return ledger.fold_log(table(spark, d, "kafka_inputs"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(table(spark, d, "points"), table(spark, d, "metric_catalog"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("filled").select("series_key", "ts")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).withColumn("value", rounded(F.col("value"), 3))


def p6_counters(spark: SparkSession, d: str) -> DataFrame:
    pairs = written(grid.consecutive_pairs(grid.source_readings(table(spark, d, "points"), table(spark, d, "metric_catalog"))))
    counters = grid.counter_metrics(pairs)
    x = grid.increments(pairs.join(counters, F.substring_index("series_key", "{", 1) == F.col("metric"), "left_semi"))
    return x.select("series_key", "ts", rounded(F.col("increment"), 3).alias("increment"), "resets", (F.col("n_readings") > 0).alias("covered"))


QUERIES = {f.__name__: f for f in (
    p2_found, p2_metric_totals, p2_tag_totals, p2_metric_sources, p2_tag_sources, p2_metric_sums, p2_tag_sums, p3_found, p3_impossible,
    p4_found, p4_items, p6_found, p6_grid, p6_counters,
)}

_TOTALS_SQL = f"""
WITH x AS ({{rows}}), t AS (
  SELECT key_name, count(*) AS n_rows, count(v) AS n_values, sum(v) / nullif(count(v), 0) AS m FROM x WHERE key_name IS NOT NULL GROUP BY 1),
l AS (SELECT key_name, v FROM x WHERE v IS NOT NULL AND key_name IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY key_name ORDER BY ts DESC, point_id DESC) = 1)
SELECT t.key_name, n_rows, n_values, {sql_rounded("m")} AS mean_value, {sql_rounded("l.v")} AS last_value
FROM t LEFT JOIN l USING (key_name)"""

_READINGS = f"""
r0 AS (SELECT p.metric, {SQL_KEY.replace("metric ||", "p.metric ||")} AS series_key, c.step_s, p.ts, {SQL_VALUE} AS v, p.write_ms, p.point_id
      FROM points p JOIN metric_catalog c ON p.metric = c.metric
      WHERE c.step_s > 0 AND p.tags IS NOT NULL AND (int_value IS NOT NULL OR float_value IS NOT NULL)),
r AS (SELECT metric, series_key, step_s, ts, v FROM r0
      QUALIFY row_number() OVER (PARTITION BY series_key, ts ORDER BY write_ms DESC NULLS LAST, point_id DESC) = 1),
pairs AS (SELECT metric, series_key, step_s, lag(ts) OVER w AS t0, lag(v) OVER w AS v0, ts AS t1, v AS v1 FROM r
          WINDOW w AS (PARTITION BY series_key ORDER BY ts))"""

#: Counters, and their increments in the cells from the first to the last reading.
_COUNTERS = f"""
counters AS (SELECT metric FROM pairs WHERE t0 IS NOT NULL GROUP BY 1
  HAVING count(*) FILTER (v1 < v0) <= 0.05 * count(*) AND count(*) FILTER (v1 > v0) >= 0.5 * count(*)),
spread AS (SELECT series_key, step_s, unnest(range(coalesce(t0, t1) // step_s, t1 // step_s + 1)) AS k, t0, t1, CASE WHEN v1 >= v0 THEN v1 - v0 ELSE v1 END AS grown, v1 < v0 AS reset
  FROM pairs WHERE metric IN (SELECT metric FROM counters)),
cells AS (SELECT series_key, (k * step_s)::INT AS ts, {sql_rounded("sum(CASE WHEN t0 IS NOT NULL THEN grown * (least(t1, (k + 1) * step_s) - greatest(t0, k * step_s)) / (t1 - t0) END)", 3)} AS increment,
  count(*) FILTER (reset AND k = (t1 - 1) // step_s) AS resets, count(*) FILTER (k = t1 // step_s) AS n_readings FROM spread GROUP BY series_key, step_s, k)"""

SQL = {
    "p2_found": """
WITH m AS (SELECT metric AS k, count(*) AS n FROM points GROUP BY 1),
e AS (SELECT k, count(*) AS n FROM (SELECT unnest(map_keys(tags)) AS k FROM points) GROUP BY 1)
SELECT 'metric' AS field, k AS key_name FROM m WHERE k IS NOT NULL AND n * 100 >= 6 * (SELECT sum(n) FROM m)
UNION ALL SELECT 'name', k FROM e WHERE n * 100 >= 6 * (SELECT sum(n) FROM e)""",
    "p2_metric_totals": _TOTALS_SQL.format(rows=f"SELECT metric AS key_name, {SQL_VALUE} AS v, ts, point_id FROM points"),
    "p2_tag_totals": _TOTALS_SQL.format(rows=f"SELECT unnest(map_keys(tags)) AS key_name, {SQL_VALUE} AS v, ts, point_id FROM points"),
    "p2_metric_sources": f"SELECT metric AS key_name, count(DISTINCT {SQL_KEY}) AS n_sources FROM points WHERE metric IS NOT NULL AND tags IS NOT NULL GROUP BY 1",
    "p2_tag_sources": f"SELECT key_name, count(DISTINCT k) AS n_sources FROM (SELECT unnest(map_keys(tags)) AS key_name, {SQL_KEY} AS k FROM points WHERE metric IS NOT NULL AND tags IS NOT NULL) GROUP BY 1",
    "p3_impossible": f"""
SELECT point_id FROM points p JOIN metric_catalog c ON p.metric = c.metric
WHERE c.step_s > 0 AND tags IS NOT NULL AND ({SQL_VALUE} < lowest OR {SQL_VALUE} > highest)""",
    "p4_found": """
WITH i AS (SELECT topic, partition_id, start_offset, stop_offset, lower(trim(state)) AS state FROM kafka_inputs
           QUALIFY row_number() OVER (PARTITION BY run_id, topic, partition_id ORDER BY logged_ms DESC, lower(trim(state)) DESC, stop_offset DESC) = 1),
m AS (SELECT DISTINCT topic, partition_id, msg_offset, batch_id, payload_crc FROM queue_messages),
l AS (SELECT m.*, EXISTS (SELECT 1 FROM i WHERE i.state = 'committed' AND i.topic = m.topic AND i.partition_id = m.partition_id
        AND m.msg_offset >= i.start_offset AND m.msg_offset < i.stop_offset) AS loaded FROM m)
SELECT topic, partition_id, msg_offset FROM l WHERE NOT loaded
AND NOT EXISTS (SELECT 1 FROM l b WHERE b.batch_id = l.batch_id AND b.payload_crc = l.payload_crc
     AND (b.loaded OR (b.topic = l.topic AND b.partition_id = l.partition_id AND b.msg_offset < l.msg_offset)))""",
    "p4_items": """
SELECT run_id, topic, partition_id, start_offset, stop_offset, CASE WHEN lower(trim(state)) = 'committed' THEN 'done' ELSE 'pending' END AS state, logged_ms AS fence
FROM kafka_inputs
QUALIFY row_number() OVER (PARTITION BY run_id, topic, partition_id ORDER BY logged_ms DESC, lower(trim(state)) DESC, stop_offset DESC, start_offset DESC) = 1""",
    "p6_found": f"""
WITH {_READINGS}
SELECT series_key, (unnest(range(t0 // step_s + 1, t1 // step_s)) * step_s)::INT AS ts FROM pairs WHERE t0 IS NOT NULL AND t1 // step_s - t0 // step_s > 1""",
    "p6_grid": f"""
WITH {_READINGS}, {_COUNTERS},
q AS (SELECT * FROM pairs WHERE metric NOT IN (SELECT metric FROM counters)),
h AS (SELECT series_key, (unnest(range(t0 // step_s + 1, t1 // step_s)) * step_s)::INT AS ts, t0, v0, t1, v1 FROM q WHERE t0 IS NOT NULL AND t1 // step_s - t0 // step_s > 1)
SELECT series_key, ((t1 // step_s) * step_s)::INT AS ts, count(*) AS n_readings, {sql_rounded("avg(v1)", 3)} AS value, FALSE AS filled, FALSE AS counter FROM q GROUP BY series_key, (t1 // step_s) * step_s
UNION ALL SELECT series_key, ts, 0, {sql_rounded("v0 + (v1 - v0) * (ts - t0) / (t1 - t0)", 3)}, TRUE, FALSE FROM h
UNION ALL SELECT series_key, ts, n_readings, increment, n_readings = 0, TRUE FROM cells""",
    "p6_counters": f"WITH {_READINGS}, {_COUNTERS} SELECT series_key, ts, increment, resets, n_readings > 0 AS covered FROM cells",
}
