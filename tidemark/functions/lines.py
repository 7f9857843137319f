"""Line protocol and JSON points as column expressions: parsing, validation, dead letters.

``put <metric> <ts> <value> <name>=<value>...``; a value with ``.``, ``e`` or ``E`` is
a float (32 bits), others are 64-bit integers, ``[a,b,...]`` is a list that is a float
list if any entry is a float.  Nothing here runs Python per row: lines are parsed by
Arrow's string kernels, JSON by Spark's expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

#: Characters of metric names, tag names and tag values (fixed value).
NAME_PATTERN = "^[A-Za-z0-9._/@-]*$"
MOST_LINE = 2048
COMMANDS = ("put", "commit", "version", "exit", "deflate", "snappy")


def charset_ok(c: Column) -> Column:
    """Only characters of names; the empty string passes, null is null."""
    return c.rlike(NAME_PATTERN)


def tokens(c: Column, separator: str = " ", *, keep_empty: bool = False) -> Column:
    """Words of a line; runs of separators count once unless ``keep_empty``."""
    plain = len(separator) == 1 and separator in " ,;:=&"  # split needs no regular expression for these
    words = F.split(c, separator if plain else "[" + separator.replace("\\", "\\\\").replace("]", "\\]") + "]", -1)
    return words if keep_empty else F.filter(words, lambda w: w != "")


def looks_like_integer(c: Column) -> Column:
    return ~c.rlike("[.eE]")


def parse_long(c: Column) -> Column:
    """64-bit integer; null for anything else, overflow included."""
    return F.when(c.rlike("^[+-]?[0-9]{1,19}$"), c.try_cast("bigint"))


def parse_float(c: Column) -> Column:
    """Finite 32-bit float; null for anything else."""
    x = F.when(c.rlike("^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("float"))
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def list_items(c: Column) -> Column:
    """Items of ``[a,b]`` as strings, null if it is no list; ``[]`` is the empty list."""
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    return F.when(c.rlike(r"^\[[^\[\]]*\]$"), F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ",", -1)))


def _longs(words: pa.Array) -> pa.Array:
    """64-bit integers; null for anything else, overflow included."""
    there = pc.fill_null(pc.match_substring_regex(words, "^[+-]?[0-9]{1,19}$"), False)
    bare = pc.replace_substring_regex(pc.if_else(there, words, pa.scalar(None, pa.string())), r"^\+", "")
    try:
        return pc.cast(bare, pa.int64())
    except pa.ArrowInvalid:  # one at least is beyond 64 bits
        return pa.array([int(x) if x is not None and -(2**63) <= int(x) < 2**63 else None for x in bare.to_pylist()], pa.int64())


def _floats(words: pa.Array) -> pa.Array:
    """Finite 32-bit floats; null for anything else."""
    there = pc.fill_null(pc.match_substring_regex(words, r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"), False)
    x = pc.cast(pc.replace_substring_regex(pc.if_else(there, words, pa.scalar(None, pa.string())), r"^\+", ""), pa.float32())
    return pc.if_else(pc.fill_null(pc.is_finite(x), False), x, pa.scalar(None, pa.float32()))


def _any(hit: pa.Array, parent: np.ndarray, rows: int) -> np.ndarray:
    """Rows one of whose items is hit."""
    return np.bincount(parent[pc.fill_null(hit, False).to_numpy(zero_copy_only=False)], minlength=rows) > 0


def _offsets(count: np.ndarray, there: np.ndarray) -> pa.Array:
    """Offsets of lists of the rows that have one."""
    return pa.array(np.append(0, np.cumsum(np.where(there, count, 0))), pa.int32(), mask=np.append(~there, False))


def parse_batch(line: pa.Array, shard_tags: tuple[str, ...]) -> list[pa.Array]:
    """The columns of PARSED of a batch of lines, each computed for all lines at once."""
    rows = len(line)
    known = pc.is_valid(line).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(pc.replace_substring_regex(line, "[\t\r\n]", " "), " ")
    words, parent = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.not_equal(words, "")
    words, parent = words.filter(filled), parent[filled.to_numpy(zero_copy_only=False)]
    n = np.bincount(parent, minlength=rows)
    start = np.cumsum(n) - n
    word = lambda k: words.take(pa.array(start + k, mask=n <= k))
    command, metric, value = word(0), word(1), word(3)
    first = _longs(metric)
    ts = _longs(word(2))
    flag = lambda a: pc.fill_null(a, False).to_numpy(zero_copy_only=False)
    # tags
    late = np.arange(len(words)) - start[parent] >= 4
    tags, owner = words.filter(pa.array(late)), parent[late]
    good = pc.and_(pc.equal(pc.count_substring(tags, "="), 1), pc.invert(pc.or_(pc.starts_with(tags, "="), pc.ends_with(tags, "="))))
    bad_tag = _any(pc.invert(good), owner, rows)
    parts = pc.list_flatten(pc.split_pattern(tags.filter(good), "="))
    keys, values = parts.take(pa.array(np.arange(0, len(parts), 2))), parts.take(pa.array(np.arange(1, len(parts), 2)))
    owner_good = owner[flag(good)]
    code = pc.dictionary_encode(keys)
    pair = np.sort(owner_good * max(len(code.dictionary), 1) + code.indices.to_numpy(zero_copy_only=False))
    twice = np.bincount(pair[1:][pair[1:] == pair[:-1]] // max(len(code.dictionary), 1), minlength=rows) > 0
    of_shard = np.bincount(owner_good[flag(pc.is_in(keys, pa.array(shard_tags, pa.string())))], minlength=rows)
    strange = "[^=A-Za-z0-9._/@-]"
    illegal = flag(pc.match_substring_regex(metric, strange)) | _any(pc.match_substring_regex(tags, strange), owner, rows)
    # value
    is_list = flag(pc.starts_with(value, "["))
    integral = flag(pc.invert(pc.match_substring_regex(value, "[.eE]")))
    nothing = pa.scalar(None, pa.string())
    one_of = lambda there: pc.if_else(pa.array(there), value, nothing)
    ints, floats = _longs(one_of(~is_list & integral)), _floats(one_of(~is_list & ~integral))
    closed = flag(pc.match_substring_regex(value, r"^\[[^\[\]]*\]$"))
    inner = pc.utf8_slice_codeunits(one_of(closed), 1, -1)
    items_of = pc.split_pattern(pc.if_else(pc.equal(inner, ""), nothing, inner), ",")
    items, holder = pc.list_flatten(items_of), pc.list_parent_indices(items_of).to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.bincount(holder, minlength=rows)
    float_list = _any(pc.match_substring_regex(items, "[.eE]"), holder, rows)
    of_floats = float_list[holder]
    int_items, float_items = _longs(items.filter(pa.array(~of_floats))), _floats(items.filter(pa.array(of_floats)))
    bad_item = _any(pc.is_null(int_items), holder[~of_floats], rows) | _any(pc.is_null(float_items), holder[of_floats], rows)
    # the first failing check names the error
    put = flag(pc.equal(command, "put"))
    scalar = flag(pc.is_valid(ints)) | flag(pc.is_valid(floats))
    checks = [
        (flag(pc.greater(pc.utf8_length(pc.utf8_rtrim(line, " ")), MOST_LINE)), "line too long"),
        (n == 0, "empty"),
        (~flag(pc.is_in(command, pa.array(COMMANDS))), "unknown command"),
        (put & (n < 5), "not enough arguments"),
        (put & ~flag(pc.greater(ts, 0)), "bad timestamp"),
        (put & flag(pc.greater_equal(ts, 2**31)), "timestamp out of range"),
        (put & is_list & ~closed, "closing bracket"),
        (put & is_list & bad_item, "bad list value"),
        (put & ~is_list & ~scalar, "bad value"),
        (put & bad_tag, "bad tag"),
        (put & twice, "duplicate tag"),
        (put & illegal, "illegal character"),
        (put & (of_shard != 1), "shard tag"),
    ]
    which = np.full(rows, len(checks))
    for k in reversed(range(len(checks))):
        which[checks[k][0]] = k
    which[~known] = len(checks)
    error = pa.array([name for _, name in checks]).take(pa.array(which, mask=which == len(checks)))
    ok = put & (which == len(checks))
    keep = lambda a: pc.if_else(pa.array(ok), a, pa.scalar(None, a.type))
    kinds = np.where(scalar & integral, 0, np.where(scalar, 1, np.where(float_list, 3, 2)))
    tag_count = np.bincount(owner_good, minlength=rows)
    mine = pa.array(ok[owner_good])
    ints_there, floats_there = ok & is_list & ~float_list, ok & is_list & float_list
    return [
        command, pc.if_else(pc.is_in(command, pa.array(("commit", "deflate", "snappy"))), first, pa.scalar(None, pa.int64())), keep(metric),
        pc.cast(keep(ts), pa.int32()), pa.MapArray.from_arrays(_offsets(tag_count, ok), keys.filter(mine), values.filter(mine)),
        pa.array(("INT", "FLOAT", "INT_LIST", "FLOAT_LIST")).take(pa.array(kinds, mask=~ok)), keep(ints), keep(floats),
        pa.ListArray.from_arrays(_offsets(size, ints_there), int_items.filter(pa.array(ints_there[holder[~of_floats]]))),
        pa.ListArray.from_arrays(_offsets(size, floats_there), float_items.filter(pa.array(floats_there[holder[of_floats]]))),
        error,
    ]


PARSED = (
    StructType().add("command", T.StringType()).add("argument", T.LongType()).add("metric", T.StringType()).add("ts", T.IntegerType()).add("tags", T.MapType(T.StringType(), T.StringType()))
    .add("value_type", T.StringType()).add("int_value", T.LongType()).add("float_value", T.FloatType()).add("int_list", T.ArrayType(T.LongType())).add("float_list", T.ArrayType(T.FloatType())).add("error", T.StringType())
)


def parse_lines(lines: DataFrame, *, column: str = "line", shard_tags: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """Every line with ``command``, the fields of its point, and ``error`` (null for a valid point).

    The first failing check names the error.  Blank lines have no command and the
    error ``empty``; lines of other commands have no point and the error null, as has
    a null line.  ``commit`` carries its number in ``argument``.  Extra columns are kept.
    Runs on Arrow batches with vectorised string kernels, no Python per line.
    """
    schema = StructType([*lines.schema.fields, *PARSED.fields])
    at = lines.columns.index(column)
    is_text = lines.schema[column].dataType.simpleString() == "string"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line = batch.column(at) if is_text else pc.cast(batch.column(at), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *parse_batch(line, shard_tags)], names=[*batch.schema.names, *PARSED.names])

    return lines.mapInArrow(kernel, schema)


def valid_points(parsed: DataFrame, *more: str) -> DataFrame:
    return parsed.where((F.col("command") == "put") & F.col("error").isNull()).select(
        "metric", "tags", "ts", "value_type", "int_value", "float_value", "int_list", "float_list", *more
    )


def dead_letters(parsed: DataFrame, *, column: str = "line") -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select(column, "error")


def validate(points: DataFrame, *, shard_tags: tuple[str, ...] | None = None) -> DataFrame:
    """``points`` with ``error``: a value there, floats finite, 0 < ts < 2^31, a tag at least, characters of names."""
    tags = F.col("tags")
    checks = [
        (F.coalesce(F.col("int_value").isNull() & F.col("float_value").isNull() & F.col("int_list").isNull() & F.col("float_list").isNull(), F.lit(True)), "no value"),
        (F.isnan("float_value") | (F.abs("float_value") == float("inf")), "not finite"),
        (F.coalesce((F.col("ts") < 0) | (F.col("ts") >= 2**31), F.lit(True)), "timestamp out of range"),
        (F.coalesce(F.size(tags) < 1, F.lit(True)) | tags.isNull(), "no tags"),
        (F.col("metric").isNull() | ~charset_ok(F.col("metric")), "illegal character"),
        (F.exists(F.map_keys(tags), lambda k: ~charset_ok(k)) | F.exists(F.map_values(tags), lambda v: ~F.coalesce(charset_ok(v), F.lit(False))), "illegal character"),
    ]
    if shard_tags is not None:
        checks.append((F.size(F.filter(F.map_keys(tags), lambda k: k.isin(*shard_tags))) != 1, "shard tag"))
    error = F.lit(None).cast("string")
    for check, name in reversed(checks):
        error = F.when(check, name).otherwise(error)
    return points.withColumn("error", error)


JSON_POINT = "STRUCT<metric: STRING, timestamp: BIGINT, value: STRING, tags: MAP<STRING, STRING>>"


def parse_json_points(bodies: DataFrame, *, column: str = "body") -> DataFrame:
    """Points of JSON bodies: one object or an array of objects, the value a number or an array of numbers.

    A metric ``host/name`` with a slash is named ``l.<name>`` and gets the tag host.
    ``error`` is null for a point; else it names what is wrong, and ``rejected`` holds
    the body (of which one row comes) or the object at fault.  Every body and object
    has a row: none is dropped.
    """
    body = F.trim(F.col(column))
    array = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    parsed = F.from_json(array, f"ARRAY<{JSON_POINT}>")
    x = bodies.select(F.col(column).alias("_body"), parsed.alias("_all")).select("_body", F.col("_all").isNull().alias("_bad"), F.explode_outer("_all").alias("p"))
    x = x.select("_body", "_bad", F.col("p").isNull().alias("_none"), "p.*").withColumn("value", F.regexp_replace("value", "\\s", ""))
    slash = F.instr("metric", "/") > 0
    host, rest = F.substring_index("metric", "/", 1), F.expr("substring(metric, instr(metric, '/') + 1)")
    tags = F.coalesce(F.col("tags"), F.create_map().cast("map<string,string>"))
    tags = F.when(slash, F.map_concat(F.map_filter(tags, lambda k, v: k != "host"), F.create_map(F.lit("host"), host))).otherwise(tags)
    value = F.col("value")
    items = list_items(value)
    is_list, floats = value.startswith("["), F.exists(items, lambda i: ~looks_like_integer(i))
    y = x.select(
        "_body", "_bad", "_none", F.when(slash, F.concat(F.lit("l."), rest)).otherwise(F.col("metric")).alias("metric"), tags.alias("tags"), "timestamp", "value",
        F.when(~is_list & looks_like_integer(value), parse_long(value)).alias("int_value"),
        F.when(~is_list & ~looks_like_integer(value), parse_float(value)).alias("float_value"),
        F.when(is_list & ~floats, F.transform(items, parse_long)).alias("int_list"),
        F.when(is_list & floats, F.transform(items, parse_float)).alias("float_list"),
    )
    no_value = F.col("int_value").isNull() & F.col("float_value").isNull() & F.col("int_list").isNull() & F.col("float_list").isNull()
    bad_item = F.coalesce(F.exists("int_list", lambda i: i.isNull()), F.exists("float_list", lambda i: i.isNull()), F.lit(False))
    error = (
        F.when(F.coalesce(F.trim("_body"), F.lit("")) == "", "empty")
        .when(F.col("_bad"), "bad JSON").when(F.col("_none"), "no object").when(F.col("metric").isNull(), "no metric")
        .when(F.coalesce(F.col("timestamp") <= 0, F.lit(True)), "bad timestamp").when(F.col("timestamp") >= 2**31, "timestamp out of range")
        .when(no_value, "bad value").when(bad_item, "bad list value")
    )
    z = y.withColumn("error", error)
    ok = F.col("error").isNull()
    rejected = F.when(F.col("error").isin("empty", "bad JSON", "no object"), F.col("_body")).otherwise(F.to_json(F.struct("metric", "timestamp", "value", "tags")))
    kind = F.when(F.col("int_value").isNotNull(), "INT").when(F.col("float_value").isNotNull(), "FLOAT").when(F.col("int_list").isNotNull(), "INT_LIST").otherwise("FLOAT_LIST")
    return z.select(
        *(F.when(ok, F.col(c)).alias(c) for c in ("metric", "tags")), F.when(ok, F.col("timestamp").cast("int")).alias("ts"),
        *(F.when(ok, F.col(c)).alias(c) for c in ("int_value", "float_value", "int_list", "float_list")), F.when(ok, kind).alias("value_type"), "error", F.when(~ok, rejected).alias("rejected"),
    )
