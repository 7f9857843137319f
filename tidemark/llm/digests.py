"""Percentiles per group with a certified rank error: merging centroid digests.

Per group, sorted values are clustered under a size function of their quantile
(fine at both ends, coarse in the middle); digests merge by clustering their
centroids again, so results of files or days combine into those of the whole.  A
second pass over the rows counts, for each estimate, the values below it and up to
it, which certifies the rank error of every estimate.

All groups of a task are clustered at once (sorted arrays, ``reduceat``), in the
first pass per split, then after one shuffle of digests; a salted level comes
between, with as many parts as keep a hot group's digests at some hundreds each.

The counting pass brings the rows of a metric's day together with the estimates of
that day's groups and of the metric's groups over all days.  A day with more rows
than one part takes is spread over several, and only its estimates are copied, so
that rows plus copies stay in proportion to the data.  Nothing is sent to all workers but
the list of those days.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

DIMENSIONS = ("dc", "host", "shard", "port")
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
KEYS = ["field", "metric", "dim", "dim_value", "day"]
KEYS_DDL = "field STRING, metric STRING, dim STRING, dim_value STRING, day INT"
DIGEST_DDL = f"{KEYS_DDL}, n BIGINT, low DOUBLE, high DOUBLE, means ARRAY<DOUBLE>, weights ARRAY<BIGINT>"
BUFFER_ROWS = 200_000
#: Digests of one group that a task of the first merging level takes, about.
FAN = 256


def percent_name(q: float) -> str:
    return f"p{round(q * 100):02d}"


def cluster(group, value, weight, low, high, *, compression: float = 600.0):
    """Digests of all groups: (groups, n, low, high, centroids per group, means, weights).

    Rows are (group number, value, weight, least and greatest value behind it).  A
    cluster spans at most one unit of ``compression / (2 pi) * asin(2 q - 1)``.
    """
    order = np.lexsort((value, group))
    g, v, w = group[order], value[order], weight[order]
    new = np.append(True, g[1:] != g[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(g)))
    n = np.add.reduceat(w, start)
    upto = np.cumsum(w)
    before = np.repeat(upto[start] - w[start], size)
    q = (upto - before - w / 2) / np.repeat(n, size)
    k = np.floor(compression / (2 * np.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1))).astype(np.int64)
    first = new | np.append(True, k[1:] != k[:-1])
    at = np.flatnonzero(first)
    weights = np.add.reduceat(w, at)
    base = v[at]  # sums of differences keep the digits of large values
    means = base + np.add.reduceat((v - np.repeat(base, np.diff(np.append(at, len(v))))) * w, at) / weights
    count = np.add.reduceat(first.astype(np.int64), start)
    return g[start], n, np.minimum.reduceat(low[order], start), np.maximum.reduceat(high[order], start), count, means, weights


def quantiles(n, low, high, count, means, weights, qs=QUANTILES) -> np.ndarray:
    """Estimates (groups x quantiles): linear between the centres of centroids, exact at both ends."""
    groups = len(n)
    end = np.cumsum(count)
    start = end - count
    owner = np.repeat(np.arange(groups), count)
    upto = np.cumsum(weights) - np.repeat(np.append(0, np.cumsum(n))[:-1], count)
    # rank of a centroid's centre; a single value sits on its own rank
    place = (upto - (weights - 1) / 2 - 0.5) / n[owner]
    key = owner + np.clip(place, 0, 1) * 0.999999
    out = np.empty((groups, len(qs)))
    for j, q in enumerate(qs):
        target = np.arange(groups) + q * 0.999999
        right = np.searchsorted(key, target)
        left = right - 1
        inside_l, inside_r = left >= start, right < end
        x0 = np.where(inside_l, key[np.maximum(left, 0)], np.arange(groups))
        y0 = np.where(inside_l, means[np.maximum(left, 0)], low)
        x1 = np.where(inside_r, key[np.minimum(right, len(key) - 1)], np.arange(groups) + 0.999999)
        y1 = np.where(inside_r, means[np.minimum(right, len(key) - 1)], high)
        with np.errstate(invalid="ignore", divide="ignore"):
            y = np.where(x1 > x0, y0 + (y1 - y0) * (target - x0) / (x1 - x0), y0)
        out[:, j] = np.clip(y, low, high)
    return out


def _expanded(points: DataFrame, *more) -> DataFrame:
    tags = F.col("tags")
    return points.where(F.col("metric").isNotNull() & F.col("ts").isNotNull()).select(
        *more, "metric", *(tags[d].alias(d) for d in DIMENSIONS), F.floor(F.col("ts") / 86400).cast("int").alias("day"),
        F.col("float_value").cast("double").alias("f"), F.col("int_value").cast("double").alias("i"),
    )


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """(code of each row, -1 for null; the distinct values)."""
    coded = pc.dictionary_encode(column)
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _groupings(table: pa.Table, whole: bool):
    """For each field and dimension: (field, dim, rows, values, group numbers, keys of groups).

    ``whole``: groups over all days instead of one per day (day None).
    """
    metric, metrics = _codes(table.column("metric").combine_chunks())
    day = table.column("day").combine_chunks()
    no_day = pc.is_null(day).to_numpy(zero_copy_only=False)
    day = pc.fill_null(day, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    f = pc.fill_null(table.column("f").combine_chunks(), np.nan).to_numpy(zero_copy_only=False)
    i = pc.fill_null(table.column("i").combine_chunks(), np.nan).to_numpy(zero_copy_only=False)
    joint = np.where(np.isnan(i), f, i)
    first, days = (0, 1) if whole or not len(day) else (int(day.min()), int(day.max() - day.min() + 1))
    for dim in ("all", *DIMENSIONS):
        if dim == "all":
            value_of, values = np.zeros(len(metric), np.int64), [None]
        else:
            value_of, values = _codes(table.column(dim).combine_chunks())
        combined = (metric * (len(values) + 1) + value_of) * days + (0 if whole else day - first)
        usable = (value_of >= 0) & (True if whole else ~no_day)
        for field, v in (("float", f), ("joint", joint)):
            rows = np.flatnonzero(usable & np.isfinite(v))
            if not len(rows):
                continue
            kinds, number = np.unique(combined[rows], return_inverse=True)
            keys = [
                (field, metrics[k // days // (len(values) + 1)], dim, values[k // days % (len(values) + 1)], None if whole else int(k % days + first))
                for k in kinds.tolist()
            ]
            yield v[rows], number, keys


def _buffers(batches: Iterator[pa.RecordBatch], rows: int = BUFFER_ROWS) -> Iterator[pa.Table]:
    held, count = [], 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def _key_arrays(keys: list[tuple]) -> list[pa.Array]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
    return [pa.array([k[j] for k in keys], t) for j, t in enumerate(kinds)]


def _lists(count: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(flat))


NAMES = [*KEYS, "n", "low", "high", "means", "weights"]


def _first_pass(compression: float):
    def kernel(batches):
        for table in _buffers(batches):
            for v, number, keys in _groupings(table, False):
                g, n, low, high, count, means, weights = cluster(number, v, np.ones(len(v), np.int64), v, v, compression=compression)
                yield pa.RecordBatch.from_arrays(
                    [*_key_arrays([keys[k] for k in g]), pa.array(n), pa.array(low), pa.array(high), _lists(count, means), _lists(count, weights)], names=NAMES
                )

    return kernel


def _merge_pass(compression: float):
    """Rows arrive sorted by key; whole groups are merged many at a time."""

    def merged(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(k).to_pylist() for k in KEYS]
        rows = list(zip(*keys))
        number = np.cumsum([0] + [a != b for a, b in zip(rows[1:], rows)])
        means = table.column("means").combine_chunks()
        size = pc.list_value_length(means).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(means).to_numpy(zero_copy_only=False)
        weight = pc.list_flatten(table.column("weights").combine_chunks()).to_numpy(zero_copy_only=False)
        low, high = (np.repeat(table.column(c).to_numpy(), size) for c in ("low", "high"))
        g, n, low, high, count, means, weights = cluster(np.repeat(number, size), flat, weight, low, high, compression=compression)
        first = np.searchsorted(number, g)
        return pa.RecordBatch.from_arrays(
            [*_key_arrays([rows[k] for k in first]), pa.array(n), pa.array(low), pa.array(high), _lists(count, means), _lists(count, weights)], names=NAMES
        )

    def kernel(batches):
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows < 4000:
                continue
            last = [held.column(k)[-1].as_py() for k in KEYS]
            cut_at = held.num_rows
            while cut_at and [held.column(k)[cut_at - 1].as_py() for k in KEYS] == last:
                cut_at -= 1
            if cut_at:
                yield merged(held.slice(0, cut_at))
                held = held.slice(cut_at)
            else:  # one group only: its digests become one, which goes on merging
                held = pa.Table.from_batches([merged(held)])
        if held is not None and held.num_rows:
            yield merged(held)

    return kernel


def merge_digests(digests: DataFrame, *, compression: float = 600.0, salts: int = 1) -> DataFrame:
    """One digest per key: of days, files or runs alike.  ``salts`` > 1 merges in two levels."""
    out = digests
    if salts > 1:
        spread = (
            out.withColumn("salt", F.pmod(F.xxhash64("n", "low", "high", "means"), F.lit(salts)))
            .repartition(*KEYS, "salt").sortWithinPartitions(*KEYS).drop("salt")
        )
        out = spread.mapInArrow(_merge_pass(compression), DIGEST_DDL)
    out = out.select(*NAMES).repartition(*KEYS).sortWithinPartitions(*KEYS)
    return out.mapInArrow(_merge_pass(compression), DIGEST_DDL)


def daily_digests(points: DataFrame, *, compression: float = 600.0) -> DataFrame:
    """Digests per field, metric, dimension value and day.

    ``field``: ``float`` (float_value) and ``joint`` (int_value, else float_value);
    ``dim``: ``all`` (the whole metric) or a tag.  Rows without a metric, a ts or a
    finite value are in no group.
    """
    rows = _expanded(points)
    parts = rows.mapInArrow(_first_pass(compression), DIGEST_DDL)
    # a group has at most one digest per buffer of rows
    salts = -(-points.count() // (FAN * BUFFER_ROWS))
    return merge_digests(parts, compression=compression, salts=salts)


def over_all_days(daily: DataFrame, *, compression: float = 600.0) -> DataFrame:
    """The daily digests merged over the days (day null)."""
    return merge_digests(daily.withColumn("day", F.lit(None).cast("int")), compression=compression)


def estimates(digests: DataFrame, qs=QUANTILES) -> DataFrame:
    """Percentiles of each digest: keys, n, and one column per quantile."""
    names = [percent_name(q) for q in qs]

    def kernel(batches):
        for b in batches:
            if not b.num_rows:
                continue
            means = b.column("means")
            count = pc.list_value_length(means).to_numpy(zero_copy_only=False)
            n, low, high = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "low", "high"))
            flat, weights = (pc.list_flatten(b.column(c)).to_numpy(zero_copy_only=False) for c in ("means", "weights"))
            x = quantiles(n, low, high, count, flat, weights, qs)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEYS), b.column("n"), *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(len(qs)))], names=[*KEYS, "n", *names])

    return digests.select(*NAMES).mapInArrow(kernel, f"{KEYS_DDL}, n BIGINT, " + ", ".join(f"{c} DOUBLE" for c in names))


def _compare(rows: pa.Table, index: dict[tuple, int], values: np.ndarray) -> np.ndarray:
    """Per group (rows of ``values``): how many values lie below each estimate, then how many up to it."""
    q = values.shape[1]
    total = np.zeros((len(index), 2 * q), np.int64)
    for whole in (False, True):
        for v, number, keys in _groupings(rows, whole):
            at = np.array([index[k] for k in keys])
            order = np.argsort(number, kind="stable")
            x, start = v[order], np.searchsorted(number[order], np.arange(len(keys)))
            limit = values[at][number[order]]
            for kind, hit in ((0, x[:, None] < limit), (1, x[:, None] <= limit)):
                total[at, kind * q : (kind + 1) * q] += np.add.reduceat(hit.astype(np.int32), start, axis=0)
    return total


def _spread_of(points: DataFrame, salts: str) -> Column:
    """Part of a row among ``salts``, from its content and, where there is one, its point_id: copies of one point are spread too."""
    unique = ["point_id"] if "point_id" in points.columns else []
    mark = F.xxhash64(*unique, "metric", F.sort_array(F.map_entries(F.col("tags"))), "ts", "float_value", "int_value")
    return F.when(F.col(salts).isNull(), 0).otherwise(F.pmod(mark, F.col(salts))).cast("int")


def _count_kernel(names: list[str], parts: list[str]):
    """Rows arrive by part (of a metric, day and salt), the estimates of a part before its readings.

    A part is known by its hash; should two share one, each still finds its own estimates.
    """

    def emit(index: dict[tuple, int], total: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(total.any(axis=1))
        keys = list(index)
        for lo in range(0, len(used), 20_000):
            some = used[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([*_key_arrays([keys[k] for k in some]), *(pa.array(np.ascontiguousarray(total[some, j])) for j in range(total.shape[1]))], names=[*KEYS, *parts])

    def known(estimates: pa.ChunkedArray, index: dict, values: np.ndarray) -> tuple[dict, np.ndarray]:
        index, fresh = dict(index), []
        for text in estimates.to_pylist():
            *key, limits = json.loads(text)
            if (key := tuple(key)) not in index:  # groups over all days come with every day
                index[key] = len(index)
                fresh.append(limits)
        return index, np.concatenate([values, np.array(fresh).reshape(-1, len(names))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values, part = {}, np.zeros((0, len(names))), None  # estimates of the part that the last buffer ended in
        for table in _buffers(batches):
            is_estimate = pc.is_valid(table.column("estimate"))
            index, values = known(table.column("estimate").filter(is_estimate), index, values)
            rows = table.filter(pc.invert(is_estimate))
            if rows.num_rows:
                yield from emit(index, _compare(rows, index, values))
            last = table.column("part")[-1]
            if last != part:  # it began in this buffer
                mine = pc.and_(is_estimate, pc.equal(table.column("part"), last))
                index, values = known(table.column("estimate").filter(mine), {}, values[:0])
                part = last

    return kernel


def rank_counts(points: DataFrame, found: DataFrame, qs=QUANTILES, *, rows_per_part: int = 1_000_000, most_spread: int = 100_000) -> DataFrame:
    """For each group: how many values lie below each of its estimates, and how many up to it.

    Days of a metric with more than ``rows_per_part`` rows are spread over parts; the
    list of such days is sent to all workers and has at most ``most_spread`` entries,
    as parts grow beyond ``rows / most_spread`` rows where that would be more.
    """
    points = points.select(*(c for c in ("point_id", "metric", "tags", "ts", "float_value", "int_value") if c in points.columns))
    names = [percent_name(q) for q in qs]
    parts = [f"{kind}_{c}" for kind in ("below", "upto") for c in names]
    # every usable row has a joint value, so these groups count the rows of each metric and day
    days = found.where("field = 'joint' and dim = 'all' and day is not null").select("metric", "day", F.col("n").alias("rows"))
    everything = days.agg(F.sum("rows")).first()[0] or 0
    per_part = max(rows_per_part, -(-everything // most_spread))
    hot = days.where(F.col("rows") > per_part).select("metric", "day", F.ceil(F.col("rows") / per_part).cast("int").alias("salts"))
    rows = (
        points.where(F.col("metric").isNotNull() & F.col("ts").isNotNull())
        .withColumn("day", F.floor(F.col("ts") / 86400).cast("int"))
        .join(F.broadcast(hot), ["metric", "day"], "left")
    )
    rows = _expanded(rows, _spread_of(points, "salts").alias("salt"))
    readings = rows.where("f is not null or i is not null").select("metric", "day", "salt", *DIMENSIONS, "f", "i", F.lit(None).cast("string").alias("estimate"))
    # one text for an estimate: columns that are null in all readings would cost as much as those that are not
    key = [F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null")) for c in ("field", "metric", "dim", "dim_value", "day")]
    packed = F.concat(F.lit("["), F.concat_ws(",", *key, F.to_json(F.array(*names))), F.lit("]"))
    groups = found.select("metric", F.col("day").alias("group_day"), packed.alias("estimate"))
    of_day = groups.where("group_day is not null").withColumn("day", F.col("group_day"))
    of_all = groups.where("group_day is null").join(days.select("metric", "day"), "metric")
    estimates_ = (
        of_day.unionByName(of_all).join(F.broadcast(hot), ["metric", "day"], "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
        .select("metric", "day", "salt", *(F.lit(None).cast("string").alias(c) for c in DIMENSIONS), *(F.lit(None).cast("double").alias(c) for c in ("f", "i")), "estimate")
    )
    # part and place in it as one number, which sorts fast
    together = (
        readings.unionByName(estimates_).withColumn("part", F.xxhash64("metric", "day", "salt").bitwiseAND(F.lit(-2)))
        .repartition("part").sortWithinPartitions(F.col("part") + F.when(F.col("estimate").isNotNull(), 0).otherwise(1))
        .drop("salt")
    )
    counted = together.mapInArrow(_count_kernel(names, parts), f"{KEYS_DDL}, " + ", ".join(f"{c} BIGINT" for c in parts))
    return counted.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in parts))


def certified_percentiles(points: DataFrame, *, qs=QUANTILES, compression: float = 600.0, rows_per_part: int = 1_000_000) -> DataFrame:
    """Percentiles per group and day, and over all days (day null), with certified rank errors.

    Keys, ``n``, one column per quantile, and ``rank_error``: the greatest distance,
    over the quantiles, between q * n and the ranks that values equal to the estimate
    hold, as a share of n, from a full count (at least the rank of a neighbour when n
    is small).  Empty input gives an empty result.
    """
    daily = cut(daily_digests(points, compression=compression))
    found = cut(estimates(daily.unionByName(over_all_days(daily, compression=compression)), qs))
    counts = rank_counts(points, found, qs, rows_per_part=rows_per_part)
    counts = counts.select(*(F.col(k).alias(f"c_{k}") for k in KEYS), *(c for c in counts.columns if c not in KEYS))
    same = None
    for k in KEYS:
        one = F.col(k).eqNullSafe(F.col(f"c_{k}"))
        same = one if same is None else same & one
    gaps = []
    for q in qs:
        c, rank = percent_name(q), F.col("n") * q
        gaps.append(F.greatest(F.col(f"below_{c}") - rank, rank - F.col(f"upto_{c}"), F.lit(0.0)) / F.col("n"))
    return found.join(counts, same).select(*KEYS, "n", *(percent_name(q) for q in qs), F.greatest(*gaps).alias("rank_error"))
