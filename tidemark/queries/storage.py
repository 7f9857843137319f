"""Queries through sinks, the stored layout, streams, packs and requests as users send them, with their SQL.

What is written goes to a folder of its own below the shared one for each call.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import lines as parsing
from tidemark.functions import times
from tidemark.operators import names, rollup, scan
from tidemark.operators.scan import AnyOf, One, Present
from tidemark.plans import query as requests
from tidemark.queries.problems import SQL_VALUE, rounded, sql_rounded
from tidemark.queries.timeseries import CONFIG, CPU, MID, NOW, SQL_TAGS, START, STOP, SQL_LINE_TEXT, as_lines, sql_query, sql_written
from tidemark.session import shared_folder, table
from tidemark.sinks import store
from tidemark.sources import packs, readers
from tidemark.streaming import ingest

DAY = START + 3 * 86400


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def _laid(points: DataFrame) -> DataFrame:
    return store.with_layout(points, config=CONFIG, now=NOW)


def store_scan(spark, d):
    """Written by generation and shard, read back for some days and two shards: partitions are pruned."""
    path = _folder(spark)
    store.write_points(_laid(table(spark, d, "points")), path)
    shards = scan.shard_names({"cluster": AnyOf(("amber", "delta"))}, ("cluster",))
    rows = readers.read_points(spark, path, start=START, stop=DAY, config=CONFIG, shards=shards)
    return scan.last_write(rows).select("metric", "tags_key", "ts", "is_float", "value")


def replayed_batches(spark, d):
    """Micro-batches by day, one of them written twice: a replay replaces itself."""
    path, points = _folder(spark), table(spark, d, "points").where("write_ms is not null")
    late = F.col("point_id") % 2 == 0
    for number, part in ((0, points.where(late)), (1, points.where(~late)), (0, points.where(late))):
        store.write_points(_laid(part), path, batch=number)
    return spark.read.parquet(path).groupBy("metric", "gen", "batch").agg(F.count("*").alias("n"), F.countDistinct("point_id").alias("n_points"))


def compact_read(spark, d):
    """Compacted: the newest write of each point and kind of value."""
    path = _folder(spark)
    laid = _laid(table(spark, d, "points").where("metric is not null and tags is not null")).withColumn("write_seq", F.col("point_id"))
    store.compact(laid, path)
    kind = F.coalesce(*(F.when(F.col(c).isNotNull(), c) for c in ("int_value", "float_value", "int_list", "float_list")))
    return spark.read.parquet(path).select("point_id", kind.alias("kind"), F.col("gen").cast("int").alias("gen"))


def stream_ingest(spark, d):
    """Lines of points through a stream into the points table, read back."""
    path = _folder(spark)
    as_lines(table(spark, d, "points")).select("line").write.text(f"{path}/lines")
    sink = store.points_sink(f"{path}/points", config=CONFIG, now=lambda: NOW)
    parsed = readers.read_lines(spark, f"{path}/lines", streaming=True)
    ingest.ingest_lines(parsed, sink, store.parquet_sink(f"{path}/dead"), f"{path}/checkpoint").awaitTermination()
    good = spark.read.parquet(f"{path}/points").groupBy("metric", "value_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    bad = spark.read.parquet(f"{path}/dead").agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("metric"), F.lit("rejected").alias("value_type"), "n", F.lit(None).cast("int").alias("last_ts"))
    return good.unionByName(bad.where("n > 0"))


def unpack_packs(spark, d):
    """Points in packs, one per batch, and out of them again."""
    wire = scan.to_wire(table(spark, d, "points"))
    batched = table(spark, d, "points").select("batch_id", *wire.columns)
    x = packs.decode_packs(packs.encode_packs(batched))
    size = F.coalesce(F.size("int_list"), F.lit(0)).cast("long"), F.coalesce(F.size("float_list"), F.lit(0)).cast("long")
    listed = F.aggregate(F.coalesce("int_list", F.array().cast("array<bigint>")), F.lit(0).cast("decimal(38,0)"), lambda a, v: a + v)
    return x.groupBy("batch_id", "metric", "value_type", "error").agg(
        F.count("*").alias("n"), F.sum("ts").alias("ts_sum"), F.sum(F.size("tags")).alias("n_tags"), F.sum(F.greatest(size[0], F.lit(0)) + F.greatest(size[1], F.lit(0))).alias("n_items"),
        F.sum(listed).cast("string").alias("list_total"), F.sum(F.col("int_value").cast("decimal(38,0)")).cast("string").alias("int_total"), F.max("float_value").alias("most"),
    )


def json_errors(spark, d):
    """Points as JSON bodies, some of them spoilt, by what is wrong with them."""
    p = table(spark, d, "points").where("int_value is not null or float_value is not null")
    at = F.col("point_id") % 7
    body = F.to_json(F.struct(
        F.when(at != 1, F.col("metric")).alias("metric"), F.when(at == 2, -F.col("ts")).otherwise(F.col("ts")).cast("long").alias("timestamp"),
        F.when(at == 3, "x").otherwise(F.coalesce(F.col("int_value").cast("string"), F.col("float_value").cast("decimal(20,4)").cast("string"))).alias("value"), "tags",
    ))
    body = F.when(at == 4, F.substring(body, 2, 10)).when(at == 5, " ").otherwise(body)
    return parsing.parse_json_points(p.select(body.alias("body"))).groupBy("error", "value_type").agg(F.count("*").alias("n"))


REQUEST = json.dumps({"start": START * 1000, "end": STOP * 1000, "queries": [{"metric": CPU, "aggregator": "max", "tags": {"cluster": "amber|delta", "dc": "north-1"}, "downsample": "1h-max"}]})
URL = {"start": str(START), "end": str(STOP), "attrs": "dc->*;cluster->amber cedar", "agrg": "min", "dsagrg": "max", "dsint": "7200"}
TEXT = requests.Query(CPU, "max", START, STOP, {"cluster": Present()}, 3600, "max")


def _values(result: DataFrame) -> DataFrame:
    return result.withColumn("value", rounded(F.col("value")))


def request_json(spark, d):
    """A request body, answered from hour roll-ups of the first six days and from readings after them."""
    points = table(spark, d, "points")
    (q,) = requests.parse_request(REQUEST)
    written = scan.last_write(points.where(F.col("metric") == CPU))
    stored = rollup.roll_up(written.where(F.col("ts") < MID), "hour", ["metric", "tags_key", "tags"])
    return _values(requests.run(points, q, stored))


def request_url(spark, d):
    """The short form of a request."""
    return _values(requests.run(table(spark, d, "points"), requests.parse_url(CPU, URL)))


def json_result(spark, d):
    """The response objects of a request, read back."""
    x = requests.json_result(requests.run(table(spark, d, "points"), TEXT))
    parsed = F.from_json("json", "metric STRING, tags MAP<STRING,STRING>, dps MAP<STRING,DOUBLE>")
    return x.select(parsed.alias("r")).select("r.metric", F.col("r.tags")["cluster"].alias("cluster"), F.explode("r.dps").alias("ts", "value")).select("metric", "cluster", F.col("ts").cast("int").alias("ts"), rounded(F.col("value")).alias("value"))


def text_result(spark, d):
    """The lines of a text response, with their values rounded."""
    x = requests.text_result(requests.run(table(spark, d, "points"), TEXT))
    words = F.split("line", " ")
    return x.select("group", "ord", F.when(F.col("ord") >= 0, words[0]).otherwise(F.col("line")).alias("head"), F.when(F.col("ord") >= 0, rounded(words[1].cast("double"))).alias("value"))


def suggest_generations(spark, d):
    """Metric names of the newest generations."""
    points = table(spark, d, "points")
    known = names.name_table(points, times.generation("ts", CONFIG, NOW))
    return names.suggest(known, "metrics", "d", 10, times.recent_generations(CONFIG, NOW, 2), per_generation=False)


def suggest_stored(spark, d):
    """Tag values by prefix from a stored dictionary, filled in two steps that overlap."""
    path, points = _folder(spark), table(spark, d, "points")
    for part in (points.where(F.col("ts") < DAY), points):
        names.store_names(names.name_table(part), path)
    return names.suggest(spark.read.parquet(path), "tagv", "nd-0", 25)


def stream_commits(spark, d):
    """Commit lines among those of points: each is answered with its number and the micro-batch."""
    path = _folder(spark)
    points = table(spark, d, "points").where("metric is not null and tags is not null")
    commits = points.where(F.col("point_id") % 100 == 0).select(F.format_string("commit %d", "point_id").alias("line"))
    commits.unionByName(as_lines(points).select("line")).coalesce(4).write.text(f"{path}/lines")
    settings = {"source": {"kind": "lines", "path": f"{path}/lines"}, "checkpoint": f"{path}/checkpoint", "sinks": [{"kind": "blackhole"}], "replies": f"{path}/replies"}
    config.start_ingest(spark, settings).awaitTermination()
    return spark.read.parquet(f"{path}/replies").select("line")


def sinks_fan_out(spark, d):
    """One batch to several sinks: rows that are dropped, a sink that fails, one that keeps all."""
    path, metrics = _folder(spark), table(spark, d, "points").select("point_id", "metric")
    dropped = F.col("metric").isNull()
    split = store.failover(store.parquet_sink(f"{path}/kept"), store.parquet_sink(f"{path}/dropped"), drop_where=dropped)
    safe = store.failover(store.failing, store.parquet_sink(f"{path}/saved"))
    store.fan_out(split, safe, store.parquet_sink(f"{path}/all"), store.blackhole)(metrics, 0)
    out = None
    for name in ("kept", "dropped", "saved", "all"):
        one = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids")).select(F.lit(name).alias("sink"), "n", "ids")
        out = one if out is None else out.unionByName(one)
    return out


def rollup_job(spark, d):
    """Roll-up jobs over stored points: the hour strategy run twice, then days from hours, replaced in place."""
    path = _folder(spark)
    w = scan.last_write(table(spark, d, "points"))
    for _ in range(2):
        rollup.roll_up_job(w, START, MID, "hour", f"{path}/hours")
    rollup.roll_up_job(spark.read.parquet(f"{path}/hours"), START, MID, "day", f"{path}/days")
    both = spark.read.parquet(f"{path}/hours").unionByName(spark.read.parquet(f"{path}/days"))
    return both.where("agg in ('max', 'min')").groupBy("metric", "resolution", "agg").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.min("value").alias("least"))


def rolling_rollups(spark, d):
    """Five-minute roll-ups of days as a stream touches them; later points come in a second run."""
    path, p = _folder(spark), table(spark, d, "points").where(F.col("metric") == CPU).withColumnRenamed("point_id", "write_seq")
    for part in (p.where(F.col("ts") < MID), p.where(F.col("ts") >= MID)):
        part.write.mode("append").parquet(f"{path}/points")
        stream = spark.readStream.schema(p.schema).parquet(f"{path}/points")
        ingest.rolling(stream, f"{path}/rolled", f"{path}/checkpoint", store=lambda: spark.read.parquet(f"{path}/points")).awaitTermination()
    return spark.read.parquet(f"{path}/rolled").where("agg = 'max'").select("metric", "tags_key", "ts", "value")


def generation_spans(spark, d):
    """Parts of the time of the points by generation, with their rows."""
    rows = times.generation_ranges(CONFIG, START, STOP)
    spans = spark.createDataFrame(rows, "start INT, stop INT, gen INT")
    points = table(spark, d, "points").where(scan.time_predicate(START, STOP))
    counted = points.groupBy(times.generation("ts", CONFIG, NOW).cast("int").alias("gen")).agg(F.count("*").alias("n"))
    return spans.join(counted, "gen", "left")


FILTERS = ("north-1", "north-1|west-1", "*")
DURATIONS = ("5s", "10m", "1h", "2d", "1w", "1y")


def tag_filters(spark, d):
    """Rows by tag filters as users write them: a filter for dc together with fixed tags."""
    points, out = table(spark, d, "points"), None
    for text in FILTERS:
        filters = {"dc": scan.parse_filter(text)} | {k: One(v) for k, v in scan.parse_fixed_tags("cluster amber").items()}
        one = points.where(scan.tag_predicate(filters)).groupBy("metric").agg(F.count("*").alias("n")).select(F.lit(text).alias("filter"), "metric", "n")
        out = one if out is None else out.unionByName(one)
    return out


def durations(spark, d):
    """Seconds of durations, and the buckets of the points at them."""
    last = table(spark, d, "points").agg(F.max("ts")).first()[0]
    seconds = spark.createDataFrame([(t, times.parse_duration(t)) for t in DURATIONS], "text STRING, seconds INT")
    return seconds.select("text", "seconds", (F.lit(last) - F.lit(last) % F.col("seconds")).alias("bucket"))


def same_rows(spark, d):
    """Two readings of one table hold the same rows; without one of them they do not."""
    p = table(spark, d, "points").select("point_id", "metric", "ts")
    early, late = p.where(F.col("ts") < MID), p.where(F.col("ts") >= MID)
    rows = [("chunks", scan.same_rows(early.unionByName(late), p)), ("part", scan.same_rows(early, p)), ("twice", scan.same_rows(p.unionByName(p), p))]
    return spark.createDataFrame(rows, "what STRING, same BOOLEAN")


def generated_sine(spark, d):
    """Generated series."""
    x = readers.sine_points(spark, start=0, stop=7200, step=60, periods=[600, 3600], amps=[10, 20], shifts=[0, 300])
    return x.select(F.col("tags")["period"].alias("period"), F.col("tags")["amp"].alias("amp"), F.col("tags")["shift"].alias("shift"), "ts", rounded(F.col("float_value").cast("double"), 3).alias("value"))


def metrics_without_integers(spark, d):
    """Metrics of the catalogue that never report an integer."""
    return table(spark, d, "metric_catalog").select("metric").subtract(table(spark, d, "points").where("int_value is not null").select("metric"))


QUERIES = {f.__name__: f for f in (
    store_scan, replayed_batches, compact_read, stream_ingest, unpack_packs, json_errors, request_json, request_url, json_result, text_result, suggest_generations, suggest_stored, stream_commits, sinks_fan_out, rollup_job, rolling_rollups, generation_spans, tag_filters, durations, same_rows, generated_sine, metrics_without_integers,
)}

_KIND = "CASE WHEN int_value IS NOT NULL THEN 'int_value' WHEN float_value IS NOT NULL THEN 'float_value' WHEN int_list IS NOT NULL THEN 'int_list' WHEN float_list IS NOT NULL THEN 'float_list' END"
_GEN = f"CASE WHEN ts < {CONFIG[0].start} OR ts >= {NOW + times.SPAN_S} THEN -1 ELSE (ts - {CONFIG[0].start}) // {times.SPAN_S} END"
_AMBER = "len(list_filter(map_keys(tags), lambda k: k = 'cluster')) = 1 AND tags['cluster'] IN ('amber', 'delta')"
_REQUEST = requests.Query(CPU, "max", START, STOP, {"cluster": AnyOf(("amber", "delta")), "dc": One("north-1")}, 3600, "max")

SQL = {
    "store_scan": f"WITH {sql_written(f'ts >= {START} AND ts < {DAY} AND {_AMBER}')} SELECT metric, tags_key, ts, is_float, v AS value FROM w",
    "replayed_batches": f"SELECT metric, ({_GEN})::INT AS gen, (point_id % 2)::BIGINT AS batch, count(*) AS n, count(*) AS n_points FROM points WHERE write_ms IS NOT NULL GROUP BY ALL",
    "compact_read": f"""SELECT point_id, {_KIND} AS kind, ({_GEN})::INT AS gen FROM points WHERE metric IS NOT NULL AND tags IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY metric, {SQL_TAGS}, ts, {_KIND} ORDER BY write_ms DESC NULLS LAST, point_id DESC) = 1""",
    "stream_ingest": f"""WITH {SQL_LINE_TEXT}, g AS (SELECT metric, kind AS value_type, ts FROM l WHERE tags['cluster'] IS NOT NULL)
SELECT metric, value_type, count(*) AS n, max(ts) AS last_ts FROM g GROUP BY 1, 2
UNION ALL SELECT NULL, 'rejected', n, NULL FROM (SELECT (SELECT count(*) FROM points) - (SELECT count(*) FROM g) AS n) WHERE n > 0""",
    "unpack_packs": """SELECT batch_id, metric, value_type, NULL::VARCHAR AS error, count(*) AS n, sum(ts)::BIGINT AS ts_sum, sum(cardinality(tags))::BIGINT AS n_tags,
  sum(CASE value_type WHEN 'INT_LIST' THEN coalesce(len(int_list), 0) WHEN 'FLOAT_LIST' THEN coalesce(len(float_list), 0) ELSE 0 END)::BIGINT AS n_items,
  sum(CASE WHEN value_type = 'INT_LIST' THEN coalesce(list_sum(int_list), 0) ELSE 0 END)::BIGINT::VARCHAR AS list_total, sum(int_value)::BIGINT::VARCHAR AS int_total, max(float_value) AS most
FROM points WHERE metric IS NOT NULL AND tags IS NOT NULL AND value_type IS NOT NULL GROUP BY ALL""",
    "json_errors": """WITH e AS (SELECT CASE WHEN point_id % 7 = 5 THEN 'empty' WHEN point_id % 7 = 4 THEN 'bad JSON' WHEN metric IS NULL OR point_id % 7 = 1 THEN 'no metric'
  WHEN point_id % 7 = 2 THEN 'bad timestamp' WHEN point_id % 7 = 3 THEN 'bad value' END AS error, int_value FROM points WHERE int_value IS NOT NULL OR float_value IS NOT NULL)
SELECT error, CASE WHEN error IS NULL THEN CASE WHEN int_value IS NOT NULL THEN 'INT' ELSE 'FLOAT' END END AS value_type, count(*) AS n FROM e GROUP BY ALL""",
    "request_json": sql_query(_REQUEST, stored_until=MID),
    "request_url": sql_query(requests.parse_url(CPU, URL)),
    "json_result": f"SELECT metric, group_tags['cluster'] AS cluster, ts, value FROM ({sql_query(TEXT)})",
    "text_result": f"""WITH r AS ({sql_query(TEXT)}), g AS (SELECT 'cluster=' || group_tags['cluster'] AS "group", ts, value FROM r)
SELECT "group", ts AS ord, ts::VARCHAR AS head, value FROM g UNION ALL SELECT DISTINCT "group", -1, "group", NULL FROM g""",
    "suggest_generations": f"SELECT DISTINCT metric AS name FROM points WHERE metric LIKE 'd%' AND ({_GEN}) IN ({', '.join(map(str, times.recent_generations(CONFIG, NOW, 2)))}) ORDER BY 1 LIMIT 10",
    "suggest_stored": "SELECT DISTINCT name FROM (SELECT unnest(map_values(tags)) AS name FROM points) WHERE name LIKE 'nd-0%' ORDER BY 1 LIMIT 25",
    "stream_commits": "SELECT 'OK ' || point_id || ' = 0' AS line FROM points WHERE metric IS NOT NULL AND tags IS NOT NULL AND point_id % 100 = 0",
    "sinks_fan_out": """SELECT 'kept' AS sink, count(*) AS n, sum(point_id)::BIGINT AS ids FROM points WHERE metric IS NOT NULL UNION ALL SELECT 'dropped', count(*), sum(point_id)::BIGINT FROM points WHERE metric IS NULL
UNION ALL SELECT x.sink, count(*), sum(point_id)::BIGINT FROM points, (VALUES ('saved'), ('all')) x(sink) GROUP BY 1""",
    "rollup_job": f"""WITH {sql_written(f'ts >= {START} AND ts < {MID}')}, r AS (SELECT metric, '5m' AS resolution, tags_key, ts // 300 AS b, max(v)::FLOAT AS hi, min(v)::FLOAT AS lo FROM w GROUP BY ALL
  UNION ALL SELECT metric, 'hour', tags_key, ts // 3600, max(v)::FLOAT, min(v)::FLOAT FROM w GROUP BY ALL UNION ALL SELECT metric, 'day', tags_key, ts // 86400, max(v)::FLOAT, min(v)::FLOAT FROM w GROUP BY ALL),
u AS (SELECT metric, resolution, 'max' AS agg, hi AS v FROM r UNION ALL SELECT metric, resolution, 'min', lo FROM r)
SELECT metric, resolution, agg, count(*) AS n, max(v) AS most, min(v) AS least FROM u GROUP BY 1, 2, 3""",
    "rolling_rollups": f"WITH {sql_written(f'metric = {CPU!r}')} SELECT metric, tags_key, ts - ts % 300 AS ts, max(v)::FLOAT AS value FROM w GROUP BY metric, tags_key, ts - ts % 300",
    "generation_spans": f"""WITH g AS (SELECT k AS gen, greatest({START}, {CONFIG[0].start} + k * {times.SPAN_S}) AS start, least({STOP}, {CONFIG[0].start} + (k + 1) * {times.SPAN_S}) AS stop FROM range(100) r(k))
SELECT gen::INT AS gen, start::INT AS start, stop::INT AS stop, (SELECT nullif(count(*), 0) FROM points p WHERE p.ts >= g.start AND p.ts < g.stop AND p.ts < {NOW + times.SPAN_S}) AS n FROM g WHERE start < stop""",
    "tag_filters": """SELECT f.filter, metric, count(*) AS n FROM points, (VALUES ('north-1', ['north-1']), ('north-1|west-1', ['north-1', 'west-1']), ('*', NULL)) f(filter, dcs)
WHERE tags['cluster'] = 'amber' AND tags['dc'] IS NOT NULL AND (dcs IS NULL OR list_contains(dcs, tags['dc'])) GROUP BY 1, 2""",
    "durations": "SELECT text, seconds, (SELECT max(ts) FROM points) - (SELECT max(ts) FROM points) % seconds AS bucket FROM (VALUES ('5s', 5), ('10m', 600), ('1h', 3600), ('2d', 172800), ('1w', 604800), ('1y', 31536000)) t(text, seconds)",
    "same_rows": "SELECT * FROM (VALUES ('chunks', TRUE), ('part', FALSE), ('twice', FALSE)) t(what, same)",
    "generated_sine": f"""SELECT p::VARCHAR AS period, a::VARCHAR AS amp, s::VARCHAR AS shift, t::INT AS ts, {sql_rounded("(sin(((t + s) % p) / p * 6.283185307179586)::FLOAT * a)::FLOAT::DOUBLE", 3)} AS value
FROM range(0, 7200, 60) r(t), (VALUES (600), (3600)) x(p), (VALUES (10), (20)) y(a), (VALUES (0), (300)) z(s)""",
    "metrics_without_integers": "SELECT metric FROM metric_catalog EXCEPT SELECT metric FROM points WHERE int_value IS NOT NULL",
}
