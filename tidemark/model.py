"""Data model: schemas and the column expressions that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS_DDL = (
    "metric STRING, tags MAP<STRING,STRING>, ts INT, value_type STRING, int_value BIGINT, "
    "float_value FLOAT, int_list ARRAY<BIGINT>, float_list ARRAY<FLOAT>, write_ms BIGINT"
)
SERIES_DDL = "metric STRING, tags MAP<STRING,STRING>, ts INT, value DOUBLE"
ROLLUP_DDL = "metric STRING, tags MAP<STRING,STRING>, ts INT, value FLOAT, resolution STRING, agg STRING"


def entries_key(entries: Column) -> Column:
    """The same of an array of (key, value) in any order."""
    entry = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    return F.array_join(F.sort_array(F.transform(entries, entry)), ",")


def tags_key(tags: str | Column = "tags") -> Column:
    """``name=value,name=value`` in ascending order; the order of the map's entries does not matter.

    Null map gives null, an empty map the empty string; a null value counts as empty.
    """
    return entries_key(F.map_entries(F.col(tags) if isinstance(tags, str) else tags))


def series_key(metric: str | Column = "metric", tags: str | Column = "tags") -> Column:
    """``metric{name=value,...}``; null if metric or tags are null (such a row belongs to no source)."""
    metric = F.col(metric) if isinstance(metric, str) else metric
    return F.concat(metric, F.lit("{"), tags_key(tags), F.lit("}"))


def scalar_value(int_value: str | Column = "int_value", float_value: str | Column = "float_value") -> Column:
    """Integers and 32-bit floats alike as double; null where neither is present."""
    int_value = F.col(int_value) if isinstance(int_value, str) else int_value
    float_value = F.col(float_value) if isinstance(float_value, str) else float_value
    return F.coalesce(int_value.cast("double"), float_value.cast("double"))


def readings(points: DataFrame) -> DataFrame:
    """Rows of ``points`` that hold a scalar value and belong to a source, with ``value`` as double."""
    return points.where(
        F.col("metric").isNotNull()
        & F.col("tags").isNotNull()
        & F.col("ts").isNotNull()
        & (F.col("int_value").isNotNull() | F.col("float_value").isNotNull())
    ).withColumn("value", scalar_value())
