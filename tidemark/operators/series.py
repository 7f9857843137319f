"""Series operators: downsampling, rate, segments, interpolation, aggregation across series.

Rows are ``<keys>, ts, value``; ``keys`` name a series, ``group`` the columns of the
group it belongs to.  Neighbours within a series are found per (series, chunk of
time), and across chunks from the chunks' first and last rows only, so that a long
series does not become one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.times import bucket_centre
from tidemark.operators import union
from tidemark.session import cut

AGGREGATES: dict[str, Callable[[Column | str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
CHUNK_S = 86400
GRID_CHUNK = 4096


def register_aggregate(name: str, aggregate: Callable[[Column | str], Column]) -> None:
    """Make a column aggregate available to downsampling, grids and requests by name."""
    AGGREGATES[name] = aggregate


def downsample(rows: DataFrame, keys: list[str], interval: int, aggregate: str) -> DataFrame:
    """One value per series and epoch-aligned bucket, at the bucket's centre; empty buckets are absent."""
    return rows.withColumn("ts", bucket_centre("ts", interval)).groupBy(*keys, "ts").agg(AGGREGATES[aggregate]("value").alias("value"))


def neighbours(rows: DataFrame, keys: list[str], *, order: list[str] = ["ts"], chunk_s: int = CHUNK_S) -> DataFrame:  # noqa: B006
    """Segments of each series: ``<keys>, x1, y1, x2, y2, first``.

    Segment (x1, x2] ends at each reading but a series' first; a first reading that
    is followed by others has x1 = x2 and ``first``, and stands for itself alone.
    Series of one reading have none.
    """
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    base = rows.select(*keys, *order, "value", F.floor(F.col("ts") / chunk_s).alias("_chunk")).withColumns(
        {"x1": F.lag("ts").over(inner), "y1": F.lag("value").over(inner), "_next": F.lead("ts").over(inner)}
    )
    columns = [*keys, "x1", "y1", F.col("ts").alias("x2"), F.col("value").alias("y2")]
    inside = base.where("x1 is not null").select(*columns, F.lit(False).alias("first"))
    edges = (
        base.where("x1 is null or _next is null")
        .withColumns({"_head": F.col("x1").isNull(), "x1": F.lag("ts").over(outer), "y1": F.lag("value").over(outer), "_more": F.lead("ts").over(outer).isNotNull()})
        .where("_head and (x1 is not null or _more)")
        .withColumns({"first": F.col("x1").isNull(), "x1": F.coalesce("x1", "ts"), "y1": F.coalesce("y1", "value")})
        .select(*columns, "first")
    )
    return inside.unionByName(edges)


def segments(rows: DataFrame, keys: list[str], **how) -> DataFrame:
    """n readings as n - 1 segments ``x1, y1, x2, y2``."""
    return neighbours(rows, keys, **how).where(~F.col("first")).drop("first")


def rate(rows: DataFrame, keys: list[str], **how) -> DataFrame:
    """Change per second at each reading but the first; equal times have no rate."""
    s = segments(rows, keys, **how)
    r = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    return s.select(*keys, F.col("x2").alias("ts"), r.alias("value")).where("value is not null")


def line_at(x: Column) -> Column:
    """Value of the segment's line at x, exact at both ends."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    return F.when(x == x1, y1).when(x == x2, y2).otherwise(y1 + ((y2 - y1) * (x - x1)) / (x2 - x1))


def aggregate_union_grid(rows: DataFrame, keys: list[str], group: list[str], aggregate: str, *, span_s: int = 300, parts: int = 1, **how) -> DataFrame:
    """Across the series of a group, at every time at which one of them has a reading: ``<group>, ts, value``.

    Each series counts between its first and last reading, interpolated linearly;
    series of one reading count for nothing.  Segments are brought together by (group,
    span of ``span_s`` seconds), so that one large group is spread over time; there sums
    and averages come from running sums of the segments' heights and slopes, in work
    linear in the segments, and extremes segment by segment.  A group with too many
    series for one task per span is also spread over ``parts`` of its series.
    """
    series_keys = list(dict.fromkeys([*group, *keys]))
    s = neighbours(rows, series_keys, **how)
    if aggregate not in union.BASIC:
        return _union_by_join(s, group, aggregate, span_s)
    begin = F.col("x1") + F.when(F.col("first"), 0).otherwise(1)
    spans = F.sequence(F.floor(begin / span_s), F.floor(F.greatest(F.col("x2"), begin) / span_s))
    part = F.pmod(F.xxhash64(*series_keys), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)
    lines = s.select(*group, part.alias("_part"), F.explode(spans).alias("_span"), "x1", F.col("y1").cast("double").alias("y1"), "x2", F.col("y2").cast("double").alias("y2"), "first", F.lit(False).alias("_time"))
    if parts > 1:  # the times of all parts of a group's series are asked of each
        x = s.select(*group, "x2").distinct()
        none = F.lit(None).cast("double")
        times = x.select(*group, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.floor(F.col("x2") / span_s).alias("_span"), F.col("x2").alias("x1"), none.alias("y1"), "x2", none.alias("y2"), F.lit(True).alias("first"), F.lit(True).alias("_time"))
        lines = lines.unionByName(times)
    by = [*group, "_span", "_part"]
    schema = StructType([*(lines.schema[g] for g in group), *union.PARTIALS.fields])
    found = lines.repartition(*by).sortWithinPartitions(*by).mapInArrow(union.kernel(len(group), span_s, aggregate, parts > 1), schema)
    if parts > 1:
        found = found.groupBy(*group, "ts").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    return found.select(*group, "ts", F.expr(union.BASIC[aggregate]).alias("value"))


def _union_by_join(s: DataFrame, group: list[str], aggregate: str, span_s: int) -> DataFrame:
    """The same for aggregates registered by name: times and segments meet in an equi-join on (group, span)."""
    s = s.withColumn("_x1", F.col("x1"))
    xs = s.select(*group, F.col("x2").alias("x")).distinct().withColumn("_span", F.floor(F.col("x") / span_s))
    lines = s.withColumn("_span", F.explode(F.sequence(F.floor((F.col("x1") + F.when(F.col("first"), 0).otherwise(1)) / span_s), F.floor(F.greatest(F.col("x2"), F.col("x1") + F.when(F.col("first"), 0).otherwise(1)) / span_s))))
    join = [*group, "_span"]
    meet = lines.select(*[F.col(c).alias(f"_g_{c}") for c in join], "x1", "y1", "x2", "y2", "first")
    on = None
    for c in join:
        one = F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        on = one if on is None else on & one
    covers = (F.col("x") <= F.col("x2")) & ((F.col("x") > F.col("x1")) | (F.col("first") & (F.col("x") == F.col("x1"))))
    return xs.join(meet, on & covers).groupBy(*group, F.col("x").alias("ts")).agg(AGGREGATES[aggregate](line_at(F.col("x"))).alias("value"))


def fixed_grid_values(s: DataFrame, interval: int) -> DataFrame:
    """Segments with the bucket centres they cover: their columns, ``x`` and ``y``; one that covers none has a null x."""
    half = interval // 2
    up = lambda x: x + F.pmod(F.lit(half) - x, F.lit(interval))  # noqa: E731  first centre from x on
    low = up(F.when(F.col("first"), F.col("x1")).otherwise(F.col("x1") + 1))
    xs = F.when(low <= F.col("x2"), F.sequence(low, F.col("x2"), F.lit(interval)))
    return s.withColumn("x", F.explode_outer(xs)).withColumn("y", line_at(F.col("x")))


def aggregate_fixed_grid(rows: DataFrame, keys: list[str], group: list[str], aggregate: str, interval: int, *, stop_at_gap: bool = True, chunk: int = GRID_CHUNK, **how) -> DataFrame:
    """Across the series of a group at bucket centres, from the bucket of the group's first reading on.

    The result ends before the first centre that no series covers (``stop_at_gap``);
    if the first centre lies before every reading it is empty.  No range join: a
    segment lists the centres in it.  Gaps are found within chunks of ``chunk`` centres
    of a group; only one row per chunk is put in order over the whole group.
    """
    s = neighbours(rows, list(dict.fromkeys([*group, *keys])), **how)
    centre = lambda x: F.floor(x / interval).cast("long")
    at = fixed_grid_values(s, interval)
    if not stop_at_gap:
        return at.where("x is not null").groupBy(*group, F.col("x").alias("ts")).agg(AGGREGATES[aggregate]("y").alias("value"))
    # one row per centre; written, as the gaps and the result both come from it
    found = cut(at.groupBy(*group, F.col("x").alias("ts")).agg(AGGREGATES[aggregate]("y").alias("value"), F.min(centre(F.col("x1"))).alias("_begin")))
    numbered = found.where("ts is not null").withColumn("_c", centre(F.col("ts"))).withColumn("_chunk", F.floor(F.col("_c") / chunk))
    inner = Window.partitionBy(*group, "_chunk").orderBy("_c")
    # the run that the chunk begins with ends where the difference of number and place first grows
    ends = numbered.select(*group, "_chunk", "_c", "_begin", (F.col("_c") - F.row_number().over(inner)).alias("_run"), (F.min("_c").over(Window.partitionBy(*group, "_chunk")) - 1).alias("_first"))
    whole = ends.groupBy(*group, "_chunk").agg(F.min("_c").alias("_lo"), F.max(F.when(F.col("_run") == F.col("_first"), F.col("_c"))).alias("_hi"), F.min("_begin").alias("_begin"))
    bare = found.where("ts is null").select(*group, F.lit(None).cast("long").alias("_chunk"), *(F.lit(None).cast("long").alias(c) for c in ("_lo", "_hi")), "_begin")
    per = whole.unionByName(bare)
    all_of = Window.partitionBy(*group)
    order = all_of.orderBy("_chunk")  # one row per chunk of a group
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = (
        per.withColumn("_b", F.min("_begin").over(all_of)).where("_chunk is not null")
        .withColumn("_from", F.greatest(F.col("_b"), F.col("_chunk") * chunk))
        .withColumn("_at_start", F.coalesce(F.col("_lo") == F.col("_from"), F.lit(False)) & (F.col("_chunk") == F.floor(F.col("_b") / chunk) + F.row_number().over(order) - 1))
        .withColumn("_full", F.col("_at_start") & (F.col("_hi") == (F.col("_chunk") + 1) * chunk - 1))
        .withColumn("_ok", F.col("_at_start") & F.coalesce(F.lag("_full").over(order), F.lit(True)))
        .withColumn("_ok", F.min(F.col("_ok").cast("int")).over(upto) == 1)
        .where("_ok")
        .select(*(F.col(c).alias(f"_g_{c}") for c in (*group, "_chunk")), F.col("_hi").alias("_limit"))
    )
    on = None
    for c in (*group, "_chunk"):
        one = F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        on = one if on is None else on & one
    return numbered.join(kept, on).where(F.col("_c") <= F.col("_limit")).select(*group, "ts", "value")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number of readings and the last one of each series."""
    last = F.max_by(F.struct("ts", "value"), "ts")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), last.alias("l")).select(*keys, "n", F.col("l.ts").alias("last_ts"), F.col("l.value").alias("last_value"))


def drop_repeats(rows: DataFrame, keys: list[str], *, chunk_s: int = CHUNK_S) -> DataFrame:
    """Readings that differ from the one before them in the series (adjacent repeats go)."""
    n = neighbours(rows, keys, chunk_s=chunk_s)
    return n.where(F.col("first") | (F.col("y2") != F.col("y1"))).select(*keys, F.col("x2").alias("ts"), F.col("y2").alias("value"))


def pack_rows(rows: DataFrame, keys: list[str], span_s: int = 3600) -> DataFrame:
    """One row per series and time span with its points as a sorted array (bounded by the span)."""
    return rows.withColumn("base", F.col("ts") - F.col("ts") % span_s).groupBy(*keys, "base").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("points"))


def unpack_rows(packed: DataFrame, keys: list[str]) -> DataFrame:
    return packed.select(*keys, F.inline("points"))
