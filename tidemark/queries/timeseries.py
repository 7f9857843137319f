"""Queries of the time-series operators over the whole tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import lines as parsing
from tidemark.functions import times
from tidemark.operators import health, names, rollup, scan, series
from tidemark.operators.scan import AnyOf, One, Present
from tidemark.plans import planner
from tidemark.plans import query as requests
from tidemark.queries.problems import SQL_VALUE, rounded, sql_rounded
from tidemark.session import shared_folder, table

START, STOP = 1709251200, 1710374400  # the days of the table
MID = START + 6 * 86400
KEYS = ["metric", "tags_key"]
CONFIG = times.periods([("01/03/24", 1)])
NOW = START + 9 * 86400

SQL_TAGS = "array_to_string(list_sort(list_transform(map_entries(tags), lambda e: e.key || '=' || coalesce(e.value, ''))), ',')"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "points")


def _written(spark: SparkSession, d: str) -> DataFrame:
    return scan.last_write(_points(spark, d))


def sql_written(where: str = "TRUE", name: str = "w") -> str:
    return f"""{name} AS (SELECT metric, tags_key, tags, ts, is_float, v FROM (
  SELECT metric, {SQL_TAGS} AS tags_key, tags, ts, int_value IS NULL AS is_float, {SQL_VALUE} AS v, write_ms, point_id FROM points
  WHERE metric IS NOT NULL AND tags IS NOT NULL AND {SQL_VALUE} IS NOT NULL AND ({where}))
  QUALIFY row_number() OVER (PARTITION BY metric, tags_key, ts, is_float ORDER BY write_ms DESC NULLS LAST, point_id DESC) = 1)"""


def _sql_filter(filters: scan.Filters) -> str:
    parts = ["TRUE"]
    for k, f in filters.items():
        if isinstance(f, One):
            parts.append(f"tags['{k}'] = '{f.value}'")
        elif isinstance(f, AnyOf):
            parts.append(f"tags['{k}'] IN ({', '.join(repr(v) for v in f.values)})")
        else:
            parts.append(f"tags['{k}'] IS NOT NULL")
    return " AND ".join(parts)


def sql_segments(source: str, keys: str, order: str = "ts") -> str:
    return f"""seg AS (SELECT * FROM (SELECT {keys}, coalesce(lag(ts) OVER o, ts) AS x1, coalesce(lag(v) OVER o, v) AS y1, ts AS x2, v AS y2,
    lag(ts) OVER o IS NULL AS first, count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WINDOW o AS (PARTITION BY {keys} ORDER BY {order})) WHERE n > 1)"""


SQL_LINE = "CASE WHEN x = x1 THEN y1 WHEN x = x2 THEN y2 ELSE y1 + ((y2 - y1) * (x - x1)) / (x2 - x1) END"


def sql_query(q: requests.Query, stored_until: int | None = None) -> str:
    """The SQL of a request, step by step as the engine takes it; buckets before ``stored_until`` come from 32-bit roll-ups."""
    groups = scan.group_names(q.filters)
    g = [f"g_{n}" for n in groups]
    keys = ", ".join([*g, "tags_key"])
    cols = "".join(f"tags['{n}'] AS g_{n}, " for n in groups)
    parts = [sql_written(f"metric = '{q.metric}' AND ts >= {q.start} AND ts < {q.stop} AND {_sql_filter(q.filters)}")]
    parts.append(f"r AS (SELECT {cols} tags_key, ts, is_float, v FROM w)")
    now, order = "r", "ts, is_float"
    if q.interval:
        i = q.interval
        down = f"{q.downsampler}(v)" if stored_until is None else f"CASE WHEN max(ts) < {stored_until} THEN {q.downsampler}(v)::FLOAT::DOUBLE ELSE {q.downsampler}(v) END"
        parts.append(f"d AS (SELECT {keys}, ts - ts % {i} + {i // 2} AS ts, {down} AS v FROM {now} GROUP BY {keys}, ts - ts % {i} + {i // 2})")
        now, order = "d", "ts"
    if q.rate:
        parts.append(f"""t AS (SELECT {keys}, ts, (v - pv) / (ts - pt) AS v FROM (SELECT {keys}, ts, v, lag(ts) OVER o AS pt, lag(v) OVER o AS pv FROM {now}
  WINDOW o AS (PARTITION BY {keys} ORDER BY {order})) WHERE pt IS NOT NULL AND pt <> ts)""")
        now, order = "t", "ts"
    parts.append(sql_segments(now, keys, order))
    lead = "".join(f"{c}, " for c in g)
    tags = "MAP {" + ", ".join(f"'{n}': g_{n}" for n in groups) + "}" if groups else "MAP()"
    same = " AND ".join([f"a.{c} IS NOT DISTINCT FROM s.{c}" for c in g] or ["TRUE"])
    group_by = "".join(f"a.{c}, " for c in g)
    if q.interval is None:
        parts.append(f"xs AS (SELECT DISTINCT {lead} x2 AS x FROM seg)")
        parts.append(f"""res AS (SELECT {group_by} x AS ts, {q.aggregate}({SQL_LINE}) AS v FROM xs a JOIN seg s ON {same}
  AND x <= x2 AND (x > x1 OR (first AND x = x1)) GROUP BY {group_by} x)""")
    else:
        i, h = q.interval, q.interval // 2
        parts.append(f"lo AS (SELECT *, x1 + CASE WHEN first THEN 0 ELSE 1 END AS f FROM seg)")
        parts.append(f"hits AS (SELECT {lead} x1, y1, x2, y2, unnest(range(f + (({h} - f) % {i} + {i}) % {i}, x2 + 1, {i})) AS x FROM lo)")
        parts.append(f"b AS (SELECT {lead} min(x1 - x1 % {i} + {h}) AS b FROM seg {'GROUP BY ' + ', '.join(g) if g else ''})")
        parts.append(f"agg AS (SELECT {lead} x AS ts, {q.aggregate}({SQL_LINE}) AS v FROM hits GROUP BY {lead} x)")
        over = f"PARTITION BY {', '.join('a.' + c for c in g)} " if g else ""
        parts.append(f"res AS (SELECT a.* FROM agg a JOIN b s ON {same} QUALIFY a.ts = s.b + (row_number() OVER ({over}ORDER BY a.ts) - 1) * {i})")
    return f"WITH {', '.join(parts)} SELECT '{q.metric}' AS metric, {tags} AS group_tags, ts, {sql_rounded('v')} AS value FROM res"


CPU, THERM, NET, DISK = "cpu.total.busy_pct", "therm.inlet.celsius", "net.ingress.bytes_s", "disk.reads.iops"
REQUESTS = {
    "filter_single": requests.Query(CPU, "max", START, STOP, {"dc": One("north-1")}),
    "filter_multi": requests.Query(CPU, "max", START, STOP, {"dc": AnyOf(("north-1", "west-1"))}),
    "filter_all": requests.Query(THERM, "min", START, STOP, {"probe": Present()}),
    "filter_conjunction": requests.Query(CPU, "min", START, STOP, {"dc": Present(), "cluster": AnyOf(("amber", "basalt", "cedar"))}),
    "group_by_tags_sum": requests.Query(THERM, "sum", START, STOP, {"dc": Present()}),
    "group_by_tags_min": requests.Query(THERM, "min", START, STOP, {"dc": Present()}),
    "group_by_tags_max": requests.Query(THERM, "max", START, STOP, {"dc": Present()}),
    "group_by_tags_avg": requests.Query(THERM, "avg", START, STOP, {"dc": Present()}),
    "interpolate_union_grid": requests.Query(NET, "avg", START, STOP, {}),
    "interpolate_fixed_grid": requests.Query(NET, "sum", START, STOP, {"dc": Present()}, 300, "avg"),
    "rate_grouped": requests.Query(DISK, "sum", START, STOP, {"dc": Present()}, None, None, True),
    "rate_downsampled": requests.Query(NET, "sum", START, STOP, {"dc": Present()}, 600, "max", True),
    "full_query_flagship": requests.Query(CPU, "sum", START, STOP, {"cluster": Present()}, 3600, "avg"),
}


def _request(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = requests.run(_points(spark, d), REQUESTS[name])
        return out.withColumn("value", rounded(F.col("value")))

    run.__name__ = name
    return run


def scan_metric_range(spark, d):
    x = scan.scan(_points(spark, d), CPU, START + 86400, STOP - 86400)
    return x.select("tags_key", "ts", "is_float", "value")


def shard_prune(spark, d):
    """Rows per shard of two shards of the one shard tag."""
    shards = scan.shard_names({"cluster": AnyOf(("amber", "delta"))}, ("cluster",))
    return _points(spark, d).withColumn("shard", scan.shard_column(("cluster",))).where(F.col("shard").isin(shards)).groupBy("shard").agg(F.count("*").alias("n"))


def tag_must_exist(spark, d):
    return _points(spark, d).where(scan.tag_predicate({"dc": Present()})).groupBy("metric").agg(F.count("*").alias("n"))


def _downsample(interval: int, aggregate: str):
    def run(spark, d):
        return series.downsample(_written(spark, d), KEYS, interval, aggregate).withColumn("value", rounded(F.col("value")))

    return run


def segments(spark, d):
    x = series.segments(_written(spark, d), KEYS, order=["ts", "is_float"])
    return x.select(*KEYS, "x1", "y1", "x2", "y2")


def gap_cutoff(spark, d):
    """Fixed grid of each metric over all its series: ends at the first centre no series covers."""
    rows = series.downsample(_written(spark, d), KEYS, 300, "max")
    x = series.aggregate_fixed_grid(rows, KEYS, ["metric"], "max", 300)
    return x.withColumn("value", rounded(F.col("value")))


def rate(spark, d):
    x = series.rate(_written(spark, d), KEYS, order=["ts", "is_float"])
    return x.withColumn("value", rounded(F.col("value")))


def _exact_sum(df: DataFrame) -> DataFrame:
    """32-bit partials: sums and averages in another order may differ in the last bit, so five digits of them are compared; extremes are exact."""
    exact = F.col("agg").isin("max", "min")
    digits = F.floor(F.log10(F.abs("value").cast("double"))) - 4
    scale = F.pow(F.lit(10.0), digits)
    return df.withColumn("value", F.when(exact | (F.col("value") == 0), F.col("value").cast("double")).otherwise(F.floor(F.col("value").cast("double") / scale + 0.50001) * scale).cast("float"))


SQL_FIVE = "CASE WHEN value = 0 OR agg IN ('max', 'min') THEN value ELSE floor(value::DOUBLE / pow(10.0, floor(log10(abs(value)::DOUBLE)) - 4) + 0.50001) * pow(10.0, floor(log10(abs(value)::DOUBLE)) - 4) END::FLOAT"


def _rollup(resolution: str):
    def run(spark, d):
        return _exact_sum(rollup.roll_up(_written(spark, d), resolution))

    return run


def rollup_day(spark, d):
    """Days from hours: the average is one of averages."""
    return _exact_sum(rollup.day_from_hours(rollup.roll_up(_written(spark, d), "hour")))


def reaggregate(spark, d):
    """Two-hour maxima from stored hour maxima."""
    hours = rollup.roll_up(_written(spark, d), "hour").where("agg = 'max'").withColumn("value", F.col("value").cast("double"))
    return series.downsample(hours, KEYS, 7200, "max")


def resolution_pick(spark, d):
    """Which resolutions serve an interval, coarsest first."""
    rows = [(i, ",".join(r or "raw" for r in planner.candidates(i))) for i in (60, 300, 900, 3600, 7200, 86400, 604800)]
    return spark.createDataFrame(rows, "interval_s INT, served_by STRING")


def rollup_stitch(spark, d):
    """Hourly maxima: hour roll-ups of the first six days, five-minute ones of one more, then readings."""
    w = _written(spark, d)
    path = f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"
    rollup.roll_up(w.where(F.col("ts") < MID), "hour").unionByName(rollup.roll_up(w.where(F.col("ts") < MID + 86400), "5m")).write.partitionBy("resolution").parquet(path)
    stored = {r: spark.read.parquet(path).where(F.col("resolution") == r) for r in ("hour", "5m")}

    def fetch(resolution, start, stop):
        rows = w.select(*KEYS, "ts", "value") if resolution is None else stored.get(resolution)
        if rows is None:
            return w.select(*KEYS, "ts", "value").limit(0)
        if resolution is not None:
            rows = rows.where("agg = 'max'").select(*KEYS, "ts", F.col("value").cast("double").alias("value"))
        return rows.where((F.col("ts") >= start) & (F.col("ts") < stop))

    x = planner.stitched(fetch, START, STOP, 3600, "max", KEYS)
    return x.withColumn("value", F.col("value").cast("float"))


def last_write_wins(spark, d):
    return _written(spark, d).select(*KEYS, "ts", "is_float", "value")


def dedup_adjacent(spark, d):
    return series.drop_repeats(_written(spark, d), [*KEYS, "is_float"])


def latest_point(spark, d):
    return series.latest(_written(spark, d), [*KEYS, "is_float"])


def latest_ts(spark, d):
    return _written(spark, d).groupBy("metric").agg(F.max("ts").alias("last_ts"))


def series_list(spark, d):
    return _written(spark, d).groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


def distinct_tag_values(spark, d):
    return health.distinct_values(_points(spark, d), CPU, "host", START, STOP)


def health_check(spark, d):
    return health.health_check(_points(spark, d), THERM, "host", STOP - 86400, 2 * 86400, {"dc": "north-1"})


def _suggest(what: str, prefix: str):
    def run(spark, d):
        return names.suggest(names.name_table(_points(spark, d)), what, prefix, 25)

    return run


def name_lookup_join(spark, d):
    """Dense ids of metrics joined back to the rows, counted."""
    points = _points(spark, d)
    numbered = names.number_names(names.name_table(points))
    return names.resolve(points.groupBy("metric").agg(F.count("*").alias("n")), numbered, "metric", "metric").select("metric", "metric_id", "n")


def union_chunks(spark, d):
    """Series read in two chunks of time and put together again."""
    w = _written(spark, d)
    early, late = w.where(F.col("ts") < MID), w.where(F.col("ts") >= MID)
    return early.unionByName(late).groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("value").alias("most"))


def queue_lag(spark, d):
    return health.queue_lag(table(spark, d, "offset_samples"))


def queue_lag_total(spark, d):
    return health.lag_summary(health.queue_lag(table(spark, d, "offset_samples")))


def generation_id(spark, d):
    g = times.generation("ts", CONFIG, NOW)
    return _points(spark, d).groupBy(g.alias("gen"), F.floor(F.col("ts") / 86400).alias("day")).agg(F.count("*").alias("n"))


def outlanders(spark, d):
    """Points before the first generation: unreachable for queries."""
    later = times.periods([("20/03/24", 1)])
    return _points(spark, d).where(times.generation("ts", later, NOW) == times.OUTSIDE).select("point_id")


def as_lines(p: DataFrame) -> DataFrame:
    """Every scalar or list point as a line of the protocol, tags in order of their names."""
    tags = F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ")
    ints = F.concat(F.lit("["), F.array_join(F.col("int_list").cast("array<string>"), ","), F.lit("]"))
    floats = F.concat(F.lit("["), F.array_join(F.transform("float_list", lambda v: v.cast("decimal(20,4)").cast("string")), ","), F.lit("]"))
    value = F.coalesce(F.col("int_value").cast("string"), F.col("float_value").cast("decimal(20,4)").cast("string"), ints, floats, F.lit(""))
    return p.select("point_id", F.concat_ws(" ", F.lit("put"), F.col("metric"), F.col("ts").cast("string"), value, tags).alias("line"))


def _lines(spark, d):
    return as_lines(_points(spark, d))


def parse_lines(spark, d):
    x = parsing.parse_lines(_lines(spark, d))
    return x.where("error is null").select("point_id", "metric", "ts", "value_type", "int_value", rounded(F.col("float_value").cast("double"), 3).alias("float_value"))


def parse_tags(spark, d):
    x = parsing.parse_lines(_lines(spark, d)).where("error is null")
    return x.select("point_id", F.explode("tags").alias("name", "value"))


def parse_lists(spark, d):
    x = parsing.parse_lines(_lines(spark, d)).where("error is null and (int_list is not null or float_list is not null)")
    values = F.coalesce(F.col("int_list").cast("array<double>"), F.col("float_list").cast("array<double>"))
    return x.select("point_id", "value_type", F.size(values).alias("n"), rounded(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


def invalid_lines(spark, d):
    """Lines of points that lack a metric, tags or a value, by error."""
    return parsing.parse_lines(_lines(spark, d)).where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def parse_json_points(spark, d):
    """All points with a value as JSON bodies and back: numbers and lists of numbers."""
    p = _points(spark, d).where("metric is not null and tags is not null")
    value = F.coalesce(
        F.col("int_value").cast("string"), F.col("float_value").cast("decimal(20,4)").cast("string"), F.to_json("int_list"),
        F.concat(F.lit("["), F.array_join(F.transform("float_list", lambda v: v.cast("decimal(20,4)").cast("string")), ","), F.lit("]")),
    )
    body = F.concat(F.lit('{"metric":'), F.to_json(F.array("metric")).substr(F.lit(2), F.length(F.to_json(F.array("metric"))) - 2), F.lit(',"timestamp":'), F.col("ts").cast("string"), F.lit(',"value":'), value, F.lit(',"tags":'), F.to_json("tags"), F.lit("}"))
    x = parsing.parse_json_points(p.where(value.isNotNull()).select(body.alias("body")))
    return x.groupBy("metric", "value_type", "error").agg(
        F.count("*").alias("n"), F.sum("int_value").cast("decimal(38,0)").cast("string").alias("total"), F.max("ts").alias("last_ts"),
        F.sum(F.when(F.col("value_type").endswith("LIST"), F.greatest(F.size("int_list"), F.size("float_list")))).alias("n_items"), rounded(F.max("float_value").cast("double"), 3).alias("most"),
    )


def list_points_scan(spark, d):
    x = scan.list_points(_points(spark, d)).where(scan.time_predicate(START, STOP))
    return x.select("point_id", "metric", "ts", F.size("doubles").alias("n"))


def list_to_double(spark, d):
    x = scan.list_points(_points(spark, d))
    return x.select("point_id", F.posexplode("doubles").alias("pos", "v")).select("point_id", "pos", rounded(F.col("v")).alias("v"))


def pack_rows(spark, d):
    x = series.pack_rows(_written(spark, d), [*KEYS, "is_float"], 3600)
    places = F.transform("points", lambda p, i: p["value"] * (i + 1))
    return x.select(
        *KEYS, "is_float", "base", F.size("points").alias("n"), F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + p["ts"]).alias("ts_sum"),
        rounded(F.aggregate(places, F.lit(0.0), lambda a, v: a + v) / F.size("points"), 2).alias("weighted"), F.element_at("points", -1)["value"].alias("last_value"),
    )


def unpack_rows(spark, d):
    keys = [*KEYS, "is_float"]
    return series.unpack_rows(series.pack_rows(_written(spark, d), keys, 3600), keys)


def shard_name(spark, d):
    return _points(spark, d).groupBy(scan.shard_column(("cluster",)).alias("shard")).agg(F.count("*").alias("n"))


def charset_check(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", parsing.charset_ok(F.col("reviewer_id")).alias("reviewer_ok"), parsing.charset_ok(F.col("title")).alias("title_ok"))


def token_split(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(parsing.tokens(F.col("title"))).alias("n_words"), F.size(parsing.tokens(F.col("title"), keep_empty=True)).alias("n_parts"))


def validate_points(spark, d):
    return parsing.validate(_points(spark, d), shard_tags=("cluster",)).groupBy("error").agg(F.count("*").alias("n"))


def events_hourly(spark, d):
    """The events table as points (metric is the kind of event, series the host), hourly averages, summed per metric."""
    e = table(spark, d, "events")
    rows = e.select(
        F.col("event_type").alias("metric"), (F.col("user_id") % 10).alias("host"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("int").alias("ts"), "value", "event_id"
    )
    newest = rows.groupBy("metric", "host", "ts").agg(F.max_by("value", "event_id").alias("value"))
    hourly = series.downsample(newest, ["metric", "host"], 3600, "avg")
    x = series.aggregate_fixed_grid(hourly, ["host"], ["metric"], "sum", 3600)
    return x.withColumn("value", rounded(F.col("value")))


QUERIES = {
    "full_query_flagship": _request("full_query_flagship"),
    **{n: _request(n) for n in REQUESTS},
    **{f"downsample_{a}": _downsample(i, a) for a, i in (("sum", 300), ("min", 3600), ("max", 86400), ("avg", 3600))},
    "rollup_5m": _rollup("5m"),
    "rollup_hour": _rollup("hour"),
    "suggest_metrics": _suggest("metrics", "c"),
    "suggest_tagk": _suggest("tagk", ""),
    "suggest_tagv": _suggest("tagv", "nd-0"),
    **{f.__name__: f for f in (
        scan_metric_range, shard_prune, tag_must_exist, segments, gap_cutoff, rate, rollup_day, reaggregate, resolution_pick, rollup_stitch,
        last_write_wins, dedup_adjacent, latest_point, latest_ts, series_list, distinct_tag_values, health_check, name_lookup_join, union_chunks,
        queue_lag, queue_lag_total, generation_id, outlanders, parse_lines, parse_tags, parse_lists, invalid_lines, parse_json_points,
        list_points_scan, list_to_double, pack_rows, unpack_rows, shard_name, charset_check, token_split, validate_points, events_hourly,
    )},
}


def _sql_downsample(interval: int, aggregate: str) -> str:
    return f"WITH {sql_written()} SELECT metric, tags_key, ts - ts % {interval} + {interval // 2} AS ts, {sql_rounded(f'{aggregate}(v)')} AS value FROM w GROUP BY ALL"


def _sql_rollup(step: int, name: str) -> str:
    aggs = " UNION ALL ".join(f"SELECT metric, tags_key, ts - ts % {step} AS ts, {a}(v)::FLOAT AS value, '{name}' AS resolution, '{a}' AS agg FROM w GROUP BY ALL" for a in rollup.PARTIALS)
    return aggs


_FIVE = f"SELECT metric, tags_key, ts, {SQL_FIVE} AS value, resolution, agg FROM"
_SHARD = "CASE WHEN len(list_filter(map_keys(tags), lambda k: k = 'cluster')) = 1 THEN 'cluster=' || tags['cluster'] END"
SQL_LINE_TEXT = """l AS (SELECT *, CASE WHEN int_value IS NOT NULL THEN 'INT' WHEN float_value IS NOT NULL THEN 'FLOAT'
    WHEN int_list IS NOT NULL THEN 'INT_LIST' WHEN float_list IS NOT NULL AND len(float_list) > 0 THEN 'FLOAT_LIST' WHEN float_list IS NOT NULL THEN 'INT_LIST' END AS kind FROM points
  WHERE metric IS NOT NULL AND tags IS NOT NULL AND (int_value IS NOT NULL OR float_value IS NOT NULL OR int_list IS NOT NULL OR float_list IS NOT NULL))"""
#: Lines as as_lines makes them, cut into words, and the error that the first failing check names.
SQL_LINE_ERRORS = """t AS (SELECT concat_ws(' ', 'put', metric, ts::VARCHAR, coalesce(int_value::VARCHAR, float_value::DECIMAL(20,4)::VARCHAR,
    '[' || array_to_string(int_list, ',') || ']', '[' || array_to_string(list_transform(float_list, lambda v: v::DECIMAL(20,4)::VARCHAR), ',') || ']', ''),
    array_to_string(list_sort(list_transform(map_entries(tags), lambda e: e.key || '=' || e.value)), ' ')) AS line FROM points),
  w AS (SELECT line, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM t),
  c AS (SELECT line, len(w) AS n, CASE WHEN regexp_full_match(w[3], '[+-]?[0-9]{1,19}') THEN try_cast(w[3] AS BIGINT) END AS ts, w[2] AS metric, w[4] AS v, w[5:] AS tags,
    list_transform(w[5:], lambda x: string_split(x, '=')) AS pairs FROM w),
  x AS (SELECT *, regexp_full_match(v, '\\[[^\\[\\]]*\\]') AS list, list_filter(string_split(v[2:-2], ','), lambda i: i <> '' OR contains(v, ',')) AS items,
    list_bool_or(list_transform(pairs, lambda p: len(p) <> 2 OR p[1] = '' OR p[2] = '')) AS bad, list_transform(pairs, lambda p: p[1]) AS names FROM c),
  e AS (SELECT CASE WHEN length(rtrim(line)) > 2048 THEN 'line too long' WHEN n < 5 THEN 'not enough arguments' WHEN ts IS NULL OR ts <= 0 THEN 'bad timestamp' WHEN ts >= 2147483648 THEN 'timestamp out of range'
    WHEN v[1] = '[' AND NOT list THEN 'closing bracket' WHEN v[1] = '[' AND list_bool_or(list_transform(items, lambda i: NOT regexp_full_match(i, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?'))) THEN 'bad list value'
    WHEN v[1] <> '[' AND NOT regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'bad value' WHEN bad THEN 'bad tag' WHEN len(list_distinct(names)) < len(names) THEN 'duplicate tag'
    WHEN NOT regexp_full_match(metric || array_to_string(list_transform(pairs, lambda p: p[1] || p[2]), ''), '[A-Za-z0-9._/@-]*') THEN 'illegal character'
    WHEN len(list_filter(names, lambda k: k = 'cluster')) <> 1 THEN 'shard tag' END AS error FROM x)"""

SQL = {
    **{n: sql_query(q) for n, q in REQUESTS.items()},
    "scan_metric_range": f"WITH {sql_written(f'metric = {CPU!r} AND ts >= {START + 86400} AND ts < {STOP - 86400}')} SELECT tags_key, ts, is_float, v AS value FROM w",
    "shard_prune": f"SELECT {_SHARD} AS shard, count(*) AS n FROM points WHERE tags['cluster'] IN ('amber', 'delta') GROUP BY 1",
    "tag_must_exist": "SELECT metric, count(*) AS n FROM points WHERE tags['dc'] IS NOT NULL GROUP BY 1",
    **{f"downsample_{a}": _sql_downsample(i, a) for a, i in (("sum", 300), ("min", 3600), ("max", 86400), ("avg", 3600))},
    "segments": f"WITH {sql_written()}, {sql_segments('w', 'metric, tags_key', 'ts, is_float')} SELECT metric, tags_key, x1, y1, x2, y2 FROM seg WHERE NOT first",
    "gap_cutoff": f"""WITH {sql_written()}, d AS (SELECT metric, tags_key, ts - ts % 300 + 150 AS ts, max(v) AS v FROM w GROUP BY ALL), {sql_segments('d', 'metric, tags_key')},
lo AS (SELECT *, x1 + CASE WHEN first THEN 0 ELSE 1 END AS f FROM seg),
hits AS (SELECT metric, x1, y1, x2, y2, unnest(range(f + ((150 - f) % 300 + 300) % 300, x2 + 1, 300)) AS x FROM lo),
b AS (SELECT metric, min(x1 - x1 % 300 + 150) AS b FROM seg GROUP BY metric), a AS (SELECT metric, x AS ts, max({SQL_LINE}) AS v FROM hits GROUP BY metric, x)
SELECT metric, ts, {sql_rounded('v')} AS value FROM a JOIN b USING (metric) QUALIFY ts = b + (row_number() OVER (PARTITION BY metric ORDER BY ts) - 1) * 300""",
    "rate": f"WITH {sql_written()}, {sql_segments('w', 'metric, tags_key', 'ts, is_float')} SELECT metric, tags_key, x2 AS ts, {sql_rounded('(y2 - y1) / (x2 - x1)')} AS value FROM seg WHERE NOT first AND x2 <> x1",
    "rollup_5m": f"WITH {sql_written()}, r AS ({_sql_rollup(300, '5m')}) {_FIVE} r",
    "rollup_hour": f"WITH {sql_written()}, r AS ({_sql_rollup(3600, 'hour')}) {_FIVE} r",
    "rollup_day": f"""WITH {sql_written()}, h AS ({_sql_rollup(3600, 'hour')}), r AS (SELECT metric, tags_key, ts - ts % 86400 AS ts,
  (CASE agg WHEN 'max' THEN max(value::DOUBLE) WHEN 'min' THEN min(value::DOUBLE) WHEN 'sum' THEN sum(value::DOUBLE) ELSE avg(value::DOUBLE) END)::FLOAT AS value, 'day' AS resolution, agg FROM h GROUP BY metric, tags_key, ts - ts % 86400, agg)
{_FIVE} r""",
    "reaggregate": f"WITH {sql_written()}, h AS (SELECT metric, tags_key, ts - ts % 3600 AS ts, max(v)::FLOAT::DOUBLE AS v FROM w GROUP BY ALL) SELECT metric, tags_key, ts - ts % 7200 + 3600 AS ts, max(v) AS value FROM h GROUP BY ALL",
    "resolution_pick": "SELECT * FROM (VALUES (60, 'raw'), (300, '5m,raw'), (900, '5m,raw'), (3600, 'hour,5m,raw'), (7200, 'hour,5m,raw'), (86400, 'day,hour,5m,raw'), (604800, 'day,hour,5m,raw')) t(interval_s, served_by)",
    "rollup_stitch": f"""WITH {sql_written()},
h AS (SELECT metric, tags_key, ts - ts % 3600 AS ts, max(v)::FLOAT AS v FROM w WHERE ts < {MID} GROUP BY ALL),
m AS (SELECT metric, tags_key, ts - ts % 300 AS ts, max(v)::FLOAT AS v FROM w WHERE ts < {MID + 86400} GROUP BY ALL),
e1 AS (SELECT max(ts) + 3600 AS t FROM h), e2 AS (SELECT max(ts) + 300 AS t FROM m WHERE ts >= (SELECT t FROM e1)),
u AS (SELECT 1 AS part, * FROM h UNION ALL SELECT 2, * FROM m WHERE ts >= (SELECT t FROM e1)
  UNION ALL SELECT 3, metric, tags_key, ts, v::FLOAT FROM w WHERE ts >= coalesce((SELECT t FROM e2), (SELECT t FROM e1)) AND ts < {STOP})
SELECT metric, tags_key, ts - ts % 3600 + 1800 AS ts, max(v) AS value FROM u GROUP BY part, metric, tags_key, ts - ts % 3600""",
    "last_write_wins": f"WITH {sql_written()} SELECT metric, tags_key, ts, is_float, v AS value FROM w",
    "dedup_adjacent": f"WITH {sql_written()}, {sql_segments('w', 'metric, tags_key, is_float')} SELECT metric, tags_key, is_float, x2 AS ts, y2 AS value FROM seg WHERE first OR y1 <> y2",
    "latest_point": f"WITH {sql_written()} SELECT metric, tags_key, is_float, count(*) AS n, max(ts) AS last_ts, arg_max(v, ts) AS last_value FROM w GROUP BY ALL",
    "latest_ts": f"WITH {sql_written()} SELECT metric, max(ts) AS last_ts FROM w GROUP BY 1",
    "series_list": f"WITH {sql_written()} SELECT metric, tags_key, count(*) AS n, min(ts) AS first_ts FROM w GROUP BY ALL",
    "distinct_tag_values": f"SELECT count(DISTINCT tags['host']) AS n_values FROM points WHERE metric = '{CPU}'",
    "health_check": f"""WITH n AS (SELECT count(DISTINCT tags['host']) FILTER (ts < {STOP - 5 * 86400}) AS n_before, count(DISTINCT tags['host']) FILTER (ts >= {STOP - 5 * 86400}) AS n_after
  FROM points WHERE metric = '{THERM}' AND tags['dc'] = 'north-1' AND ts >= {STOP - 7 * 86400} AND ts < {STOP - 3 * 86400})
SELECT n_before, n_after, (n_before - n_after) / nullif(n_before, 0) < 0.3 AS healthy FROM n""",
    "suggest_metrics": "SELECT DISTINCT metric AS name FROM points WHERE metric LIKE 'c%' ORDER BY 1 LIMIT 25",
    "suggest_tagk": "SELECT DISTINCT name FROM (SELECT unnest(map_keys(tags)) AS name FROM points) ORDER BY 1 LIMIT 25",
    "suggest_tagv": "SELECT DISTINCT name FROM (SELECT unnest(map_values(tags)) AS name FROM points) WHERE name LIKE 'nd-0%' ORDER BY 1 LIMIT 25",
    "name_lookup_join": "SELECT metric, dense_rank() OVER (ORDER BY metric) AS metric_id, n FROM (SELECT metric, count(*) AS n FROM points WHERE metric IS NOT NULL GROUP BY 1)",
    "union_chunks": f"WITH {sql_written()} SELECT metric, tags_key, count(*) AS n, max(v) AS most FROM w GROUP BY ALL",
    "queue_lag": "SELECT topic, partition_id, latest, consumed, latest - coalesce(consumed, 0) AS lag FROM offset_samples QUALIFY row_number() OVER (PARTITION BY topic, partition_id ORDER BY sample_ms DESC, latest DESC, coalesce(consumed, -1) DESC) = 1",
    "queue_lag_total": """WITH l AS (SELECT topic, latest - coalesce(consumed, 0) AS lag FROM offset_samples QUALIFY row_number() OVER (PARTITION BY topic, partition_id ORDER BY sample_ms DESC, latest DESC, coalesce(consumed, -1) DESC) = 1)
SELECT topic, sum(lag)::BIGINT AS total_lag, max(lag) AS most_lag FROM l GROUP BY 1""",
    "generation_id": f"""SELECT CASE WHEN ts < {CONFIG[0].start} OR ts >= {NOW + times.SPAN_S} THEN -1 ELSE (ts - {CONFIG[0].start}) // {times.SPAN_S} END AS gen, ts // 86400 AS day, count(*) AS n FROM points GROUP BY ALL""",
    "outlanders": f"SELECT point_id FROM points WHERE ts < {times.periods([('20/03/24', 1)])[0].start} OR ts >= {NOW + times.SPAN_S}",
    "parse_lines": f"WITH {SQL_LINE_TEXT} SELECT point_id, metric, ts, kind AS value_type, int_value, {sql_rounded('(float_value::DECIMAL(20,4))::FLOAT::DOUBLE', 3)} AS float_value FROM l WHERE tags['cluster'] IS NOT NULL",
    "parse_tags": f"WITH {SQL_LINE_TEXT} SELECT point_id, unnest(map_keys(tags)) AS name, unnest(map_values(tags)) AS value FROM l WHERE tags['cluster'] IS NOT NULL",
    "parse_lists": f"""WITH {SQL_LINE_TEXT}, v AS (SELECT point_id, kind, coalesce(int_list::DOUBLE[], list_transform(float_list, lambda x: x::DECIMAL(20,4)::FLOAT::DOUBLE)) AS v FROM l WHERE tags['cluster'] IS NOT NULL)
SELECT point_id, kind AS value_type, len(v) AS n, {sql_rounded("coalesce(list_sum(v), 0)", 3)} AS total FROM v WHERE kind IN ('INT_LIST', 'FLOAT_LIST')""",
    "invalid_lines": f"WITH {SQL_LINE_ERRORS} SELECT error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY 1",
    "validate_points": """WITH e AS (SELECT CASE WHEN int_value IS NULL AND float_value IS NULL AND int_list IS NULL AND float_list IS NULL THEN 'no value' WHEN NOT isfinite(float_value) THEN 'not finite'
  WHEN ts IS NULL OR ts < 0 THEN 'timestamp out of range' WHEN tags IS NULL OR cardinality(tags) < 1 THEN 'no tags'
  WHEN metric IS NULL OR NOT regexp_full_match(metric, '[A-Za-z0-9._/@-]*') OR len(list_filter(map_entries(tags), lambda e: NOT coalesce(regexp_full_match(e.key || e.value, '[A-Za-z0-9._/@-]*'), FALSE))) > 0 THEN 'illegal character'
  WHEN NOT list_contains(map_keys(tags), 'cluster') THEN 'shard tag' END AS error FROM points)
SELECT error, count(*) AS n FROM e GROUP BY 1""",
    "parse_json_points": f"""WITH {SQL_LINE_TEXT} SELECT metric, kind AS value_type, NULL::VARCHAR AS error, count(*) AS n, sum(int_value)::VARCHAR AS total, max(ts) AS last_ts,
  sum(CASE WHEN kind IN ('INT_LIST', 'FLOAT_LIST') THEN len(coalesce(int_list::DOUBLE[], float_list::DOUBLE[])) END)::BIGINT AS n_items, {sql_rounded("max((float_value::DECIMAL(20,4))::FLOAT)::DOUBLE", 3)} AS most FROM l GROUP BY 1, 2""",
    "list_points_scan": f"SELECT point_id, metric, ts, len(coalesce(int_list::DOUBLE[], float_list::DOUBLE[])) AS n FROM points WHERE (value_type IN ('INT_LIST', 'FLOAT_LIST') OR int_list IS NOT NULL OR float_list IS NOT NULL) AND ts >= {START} AND ts < {STOP}",
    "list_to_double": f"SELECT point_id, pos, {sql_rounded('v')} AS v FROM (SELECT point_id, unnest(coalesce(int_list::DOUBLE[], float_list::DOUBLE[])) AS v, unnest(range(len(coalesce(int_list::DOUBLE[], float_list::DOUBLE[])))) AS pos FROM points WHERE int_list IS NOT NULL OR float_list IS NOT NULL)",
    "pack_rows": f"""WITH {sql_written()}, p AS (SELECT *, ts - ts % 3600 AS base, row_number() OVER (PARTITION BY metric, tags_key, is_float, ts - ts % 3600 ORDER BY ts) AS i FROM w)
SELECT metric, tags_key, is_float, base, count(*) AS n, sum(ts)::BIGINT AS ts_sum, {sql_rounded("sum(v * i ORDER BY i) / count(*)", 2)} AS weighted, arg_max(v, ts) AS last_value FROM p GROUP BY metric, tags_key, is_float, base""",
    "unpack_rows": f"WITH {sql_written()} SELECT metric, tags_key, is_float, ts, v AS value FROM w",
    "shard_name": f"SELECT {_SHARD} AS shard, count(*) AS n FROM points GROUP BY 1",
    "charset_check": "SELECT doc_id, regexp_full_match(reviewer_id, '[A-Za-z0-9._/@-]*') AS reviewer_ok, regexp_full_match(title, '[A-Za-z0-9._/@-]*') AS title_ok FROM documents",
    "token_split": "SELECT doc_id, len(list_filter(string_split(title, ' '), lambda x: x <> '')) AS n_words, len(string_split(title, ' ')) AS n_parts FROM documents",
    "events_hourly": f"""WITH n AS (SELECT event_type AS metric, user_id % 10 AS host, floor(epoch(ts))::BIGINT AS ts, arg_max(value, event_id) AS v FROM events GROUP BY ALL),
d AS (SELECT metric, host, ts - ts % 3600 + 1800 AS ts, avg(v) AS v FROM n GROUP BY ALL), {sql_segments('d', 'metric, host')},
lo AS (SELECT *, x1 + CASE WHEN first THEN 0 ELSE 1 END AS f FROM seg),
hits AS (SELECT metric, x1, y1, x2, y2, unnest(range(f + ((1800 - f) % 3600 + 3600) % 3600, x2 + 1, 3600)) AS x FROM lo),
b AS (SELECT metric, min(x1 - x1 % 3600 + 1800) AS b FROM seg GROUP BY metric), a AS (SELECT metric, x AS ts, sum({SQL_LINE}) AS v FROM hits GROUP BY metric, x)
SELECT metric, ts, {sql_rounded('v')} AS value FROM a JOIN b USING (metric) QUALIFY ts = b + (row_number() OVER (PARTITION BY metric ORDER BY ts) - 1) * 3600""",
}
