"""Scans: metric, time range, tag filters, value kinds; last write wins; grouping keys."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import entries_key, scalar_value


#: Room for a 64-bit tie below a write time, either sign (fixed value).
TIES = Decimal(2 * 10**19)


@dataclass(frozen=True)
class One:
    """The tag has this value; it is no grouping key."""

    value: str


@dataclass(frozen=True)
class AnyOf:
    """The tag has one of these values; it is a grouping key."""

    values: tuple[str, ...]


@dataclass(frozen=True)
class Present:
    """The tag is there, with any value; it is a grouping key."""


Filter = One | AnyOf | Present
Filters = dict[str, Filter]


def parse_filter(text: str) -> Filter:
    """``*``, ``a|b`` or ``a``."""
    if text == "*":
        return Present()
    parts = tuple(p for p in text.split("|") if p)
    if not parts:
        raise ValueError("empty tag filter")
    return AnyOf(parts) if "|" in text else One(parts[0])


def parse_arrow_filters(text: str) -> Filters:
    """``name->*;name->a b;name->a``."""
    out: Filters = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, arrow, values = part.partition("->")
        words = values.split()
        if not arrow or not name or not words:
            raise ValueError(f"not a tag filter: {part!r}")
        out[name] = Present() if words == ["*"] else One(words[0]) if len(words) == 1 else AnyOf(tuple(words))
    return out


def parse_fixed_tags(text: str) -> dict[str, str]:
    """``name value,name value``."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        words = part.split()
        if len(words) != 2:
            raise ValueError(f"not a tag and its value: {part!r}")
        out[words[0]] = words[1]
    return out


def group_names(filters: Filters) -> list[str]:
    return sorted(k for k, f in filters.items() if not isinstance(f, One))


def shard_names(filters: Filters, shard_tags: tuple[str, ...]) -> list[str] | None:
    """Values of the one shard tag that must be filtered; ``*`` is not allowed on it."""
    used = [k for k in filters if k in shard_tags]
    if len(used) != 1:
        raise ValueError(f"exactly one of {shard_tags} must be filtered")
    f = filters[used[0]]
    if isinstance(f, Present):
        raise ValueError(f"{used[0]} needs values")
    return [f"{used[0]}={v}" for v in (f.values if isinstance(f, AnyOf) else (f.value,))]


def shard_column(shard_tags: tuple[str, ...], tags: str = "tags") -> Column:
    """``name=value`` of a row's one shard tag, null if it has none or several."""
    found = F.filter(F.map_entries(tags), lambda e: e["key"].isin(*shard_tags))
    return F.when(F.size(found) == 1, F.concat(found[0]["key"], F.lit("="), found[0]["value"]))


def tag_predicate(filters: Filters, tags: str = "tags") -> Column:
    out = F.lit(True)
    for name, f in filters.items():
        value = F.col(tags)[name]
        if isinstance(f, One):
            out &= value == f.value
        elif isinstance(f, AnyOf):
            out &= value.isin(*f.values)
        else:
            out &= value.isNotNull()
    return out


def time_predicate(start: int, stop: int) -> Column:
    """Half-open: start <= ts < stop."""
    return (F.col("ts") >= start) & (F.col("ts") < stop)


def last_write(points: DataFrame, *, tie: str | None = "point_id") -> DataFrame:
    """Of the writes of one (metric, tags, ts, int or float) the newest: greatest write_ms (null lowest), then
    ``tie``, or where a table has no such column the place within the micro-batch (``write_seq``) or the micro-batch.

    Partial aggregation before the shuffle; nothing is sorted.  Columns: metric,
    tags_key, tags, ts, is_float, value.
    """
    ties = [c for c in (tie, "write_seq", "batch") if c in points.columns]
    # write time and tie as one decimal number: fixed-size buffers keep the aggregation a hash aggregation, without sorts
    order = F.coalesce("write_ms", F.lit(-(2**62))).cast("decimal(19,0)") * F.lit(TIES).cast("decimal(20,0)")
    order = order + F.coalesce(F.col(ties[0]).cast("long"), F.lit(-(2**63))) if ties else order
    rows = points.where(F.col("metric").isNotNull() & F.col("tags").isNotNull() & F.col("ts").isNotNull()).withColumn("value", scalar_value()).where("value is not null")
    newest = (
        rows.select("metric", F.sort_array(F.map_entries("tags")).alias("entries"), "ts", F.col("int_value").isNull().alias("is_float"), "value", order.alias("o"))
        .groupBy("metric", "entries", "ts", "is_float")
        .agg(F.max_by("value", "o").alias("value"))
    )
    tags = F.map_from_entries("entries")
    return newest.select("metric", entries_key(F.col("entries")).alias("tags_key"), tags.alias("tags"), "ts", "is_float", "value")


def scan(points: DataFrame, metric: str, start: int, stop: int, filters: Filters | None = None) -> DataFrame:
    """Series of one metric: predicates on plain columns reach the Parquet scan, tag predicates follow there."""
    rows = points.where((F.col("metric") == metric) & time_predicate(start, stop) & tag_predicate(filters or {}))
    return last_write(rows)


def list_points(points: DataFrame) -> DataFrame:
    """List-valued points with both lists and the list as doubles."""
    kinds = F.col("value_type").isin("INT_LIST", "FLOAT_LIST") | F.col("int_list").isNotNull() | F.col("float_list").isNotNull()
    doubles = F.coalesce(F.col("int_list").cast("array<double>"), F.col("float_list").cast("array<double>"))
    return points.where(kinds).withColumn("doubles", doubles)


def to_wire(points: DataFrame) -> DataFrame:
    """Stored rows back in the ingest schema."""
    return points.select("metric", "tags", "ts", "value_type", "int_value", "float_value", "int_list", "float_list")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Do two tables hold the same rows, counting repeats?  (Columns in the same order; no maps.)"""
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)
