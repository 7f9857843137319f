"""Distinct counts by linear counting: hashed bits in fixed bitmaps.

Every identifier sets one bit of a bitmap of m bits; with z of them still empty,
``m * ln(m / z)`` estimates the number of distinct identifiers.  Bitmaps of one
grouping have one size, sized for a target relative standard error at the greatest
count that one of its groups can hold, so partial results (days, files, runs) merge
by bitwise union.

A bitmap is kept as blocks of 65,536 bits, empty ones left out: a block is the sorted
places of its bits (two bytes each) or, from 4,096 bits on, the 8 KiB themselves.
Each task makes the blocks of all eight groupings from its rows, so only blocks are
shuffled, never identifiers; their union is one more shuffle at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITIES = ("metrics", "tag_names", "tag_values", "hosts", "traces", "sources")
FLAGS = (("day", 4), ("metric", 2), ("dc", 1))
KEYS = ["entity", "by", "day", "metric", "dc"]
BLOCKS_DDL = "entity INT, by INT, day INT, metric STRING, dc STRING, block BIGINT, ones INT, data BINARY"
BLOCK = 16  # bits of a place within its block
DENSE = 4096  # set bits from which a block is kept as a bitmap
BUFFER_ROWS = 200_000
BUFFER_BITS = 4_000_000
#: Blocks of one place that a task of the first level unites, about.
FAN = 512


def standard_error(bits: int, count: float) -> float:
    """Relative standard error of the estimate for ``count`` distinct identifiers in ``bits`` bits."""
    if count <= 0:
        return 0.0
    load = count / bits
    if load < 1e-4:  # the series of (e^t - t - 1) / t^2
        return math.sqrt(0.5 / bits)
    if load > 700:
        return math.inf
    return math.sqrt((math.exp(load) - load - 1) / bits) / load


def bits_for(count: int, error: float) -> int:
    """The least power of two of bits (64 at least) with at most ``error`` up to ``count`` identifiers.

    The estimate must not run full either: at least 5 standard deviations of empty bits remain.
    """
    bits = 64
    while standard_error(bits, max(count, 1)) > error or math.sqrt(0.5 / bits) > error or (math.exp(-min(count / bits, 700)) * bits < 25 and count > bits):
        bits *= 2
    return bits


def sizes_of(points: DataFrame, error: float = 0.01) -> dict[int, int]:
    """Bits of a bitmap for each grouping: enough for the rows or tag entries of its largest group."""
    tags = F.col("tags")
    fine = points.groupBy(F.floor(F.col("ts") / 86400).alias("day"), "metric", tags["dc"].alias("dc")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.size(tags), F.lit(0))), F.lit(0)).alias("entries")
    )
    cube = fine.withColumn("by", F.explode(F.array(*(F.lit(k) for k in range(8)))))
    keys = [F.when(F.col("by").bitwiseAND(b) > 0, F.col(c)).alias(c) for c, b in FLAGS]
    per = cube.groupBy("by", *keys).agg(F.greatest(F.sum("n"), F.sum("entries")).alias("most")).groupBy("by").agg(F.max("most").alias("most"))
    most = {r.by: r.most for r in per.collect()}  # eight rows
    return {by: bits_for(max(1, most.get(by, 1)), error) for by in range(8)}


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of 64."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _hashed(strings: pa.Array, kind: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(hash of each string, its code or -1 for null, the distinct strings)."""
    coded = pc.dictionary_encode(strings)
    code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.to_pylist()
    salt = np.uint64((kind + 1) * 0x9E3779B97F4A7C15 % 2**64)
    of = _mixed(pd.util.hash_array(np.array([*distinct, ""], dtype=object), categorize=False) + salt)
    return of[code], code, distinct


def _identifiers(table: pa.Table) -> tuple[np.ndarray, list[tuple], list[tuple[np.ndarray, np.ndarray]]]:
    """(group of each row, (day, metric, dc) of each group, per entity: row and 64-bit hash of each identifier)."""
    n = table.num_rows
    day_column = table.column("day").combine_chunks()
    day = pc.fill_null(day_column, -(2**31)).to_numpy(zero_copy_only=False).astype(np.int64)
    metric_hash, metric, metrics = _hashed(table.column("metric").combine_chunks(), 0)
    names, values = table.column("names").combine_chunks(), table.column("vals").combine_chunks()
    parent = pc.list_parent_indices(names).to_numpy(zero_copy_only=False).astype(np.int64)
    name_hash, name, distinct = _hashed(pc.list_flatten(names), 1)
    value_hash, value, value_of = _hashed(pc.list_flatten(values), 2)
    known = value >= 0
    place = {k: distinct.index(k) if k in distinct else -2 for k in ("dc", "host", "trace")}
    dc = np.full(n, -1)
    at = name == place["dc"]
    dc[parent[at]] = value[at]
    # the sum over entries does not depend on their order
    pair = _mixed(name_hash * np.uint64(3) + np.where(known, value_hash, np.uint64(1)))
    upto = np.append(np.uint64(0), np.cumsum(pair, dtype=np.uint64))
    count = np.bincount(parent, minlength=n)
    end = np.cumsum(count)
    source = _mixed(metric_hash + _mixed(upto[end] - upto[end - count]) + count.astype(np.uint64))
    own = np.flatnonzero((metric >= 0) & pc.is_valid(names).to_numpy(zero_copy_only=False))
    rows = np.arange(n)
    entities = [(rows[metric >= 0], metric_hash[metric >= 0]), (parent, name_hash), (parent[known], value_hash[known])]
    for tag in ("host", "trace"):
        at = (name == place[tag]) & known
        entities.append((parent[at], value_hash[at]))
    entities.append((own, source[own]))
    days, day_code = np.unique(day, return_inverse=True)
    kinds, group = np.unique((day_code * (len(metrics) + 1) + metric + 1) * (len(value_of) + 1) + dc + 1, return_inverse=True)
    keys = []
    for k in kinds.tolist():
        k, c = divmod(k, len(value_of) + 1)
        d, m = divmod(k, len(metrics) + 1)
        keys.append((None if days[d] == -(2**31) else int(days[d]), metrics[m - 1] if m else None, value_of[c - 1] if c else None))
    return group, keys, entities


def _blocks(number: np.ndarray, place: np.ndarray, keys: list[tuple], data: bool = True) -> pa.RecordBatch:
    """Blocks of sorted, distinct (key number, place of the bit); keys are (entity, by, day, metric, dc)."""
    block = place >> BLOCK
    first = np.append(True, (number[1:] != number[:-1]) | (block[1:] != block[:-1]))[: len(number)]
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(number)))
    low = (place & (2**BLOCK - 1)).astype(np.uint16)
    if not data:
        content = pa.nulls(len(start), pa.binary())
    elif len(size) and size.max() >= DENSE:
        content = pa.array([_dense(low[a : a + n]) if n >= DENSE else low[a : a + n].tobytes() for a, n in zip(start, size)], pa.binary())
    else:
        offsets = np.append(0, np.cumsum(size * 2)).astype(np.int32)
        content = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(low.tobytes())])
    mine = [keys[k] for k in number[start].tolist()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays(
        [*(pa.array([k[j] for k in mine], t) for j, t in enumerate(kinds)), pa.array(block[start]), pa.array(size.astype(np.int32)), content],
        names=[f.split()[0] for f in BLOCKS_DDL.split(", ")],
    )


def _dense(low: np.ndarray) -> bytes:
    bits = np.zeros(2**BLOCK, np.uint8)
    bits[low] = 1
    return np.packbits(bits).tobytes()


def _places(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each block, their places in it, one block after the other)."""
    size = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(size) or size.max() < 2**BLOCK // 8:
        return size // 2, np.frombuffer(b"".join(data.to_pylist()), np.uint16).astype(np.int64)
    parts = [np.frombuffer(d, np.uint16) if len(d) < 2**BLOCK // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(d, np.uint8))) for d in data.to_pylist()]
    return np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts).astype(np.int64)


def partial_bitmaps(points: DataFrame, bits: dict[int, int]) -> DataFrame:
    """Blocks of the bitmaps of all eight groupings, one set for each buffer of rows: ``BLOCKS_DDL``.

    Null identifiers set no bit.  Null grouping values are groups of their own.  A
    source is metric and tags, whatever the order of the entries.
    """
    widest = max(bits.values())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buffers(batches):
            group, keys, entities = _identifiers(table)
            coarse = {}
            for by in bits:
                of = [tuple(v if by & b else None for v, (_, b) in zip(k, FLAGS)) for k in keys]
                index = {k: j for j, k in enumerate(dict.fromkeys(of))}
                coarse[by] = list(index), np.array([index[k] for k in of])
            for entity, (row, h) in enumerate(entities):
                fine = np.unique(group[row] * widest + (h & np.uint64(widest - 1)).astype(np.int64))
                for by, (kept, number_of) in coarse.items():
                    number, place = number_of[fine // widest], fine % widest & (bits[by] - 1)
                    pair = np.unique(number * bits[by] + place)
                    if len(pair):
                        yield _blocks(pair // bits[by], pair % bits[by], [(entity, by, *k) for k in kept])

    tags = F.col("tags")
    rows = points.select(F.floor(F.col("ts") / 86400).cast("int").alias("day"), "metric", F.map_keys(tags).alias("names"), F.map_values(tags).alias("vals"))
    return rows.mapInArrow(kernel, BLOCKS_DDL)


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, count = [], 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= BUFFER_ROWS:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def _union_kernel(data: bool):
    def united(table: pa.Table, data: bool) -> pa.RecordBatch:
        keys = list(zip(*(table.column(c).to_pylist() for c in (*KEYS, "block"))))
        number = np.cumsum([0] + [a != b for a, b in zip(keys[1:], keys)])
        size, place = _places(table.column("data").combine_chunks())
        pair = np.unique(np.repeat(number, size) << BLOCK | place)
        whole, first = pair >> BLOCK, np.searchsorted(number, np.arange(number[-1] + 1))
        block = np.array([keys[k][5] for k in first])
        return _blocks(whole, (block[whole] << BLOCK) + (pair & (2**BLOCK - 1)), [keys[k][:5] for k in first], data)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bits = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            bits += pc.sum(batch.column("ones")).as_py()
            if bits < BUFFER_BITS:
                continue
            table = pa.Table.from_batches(held)
            last = [table.column(c)[-1].as_py() for c in (*KEYS, "block")]
            cut = table.num_rows
            while cut and [table.column(c)[cut - 1].as_py() for c in (*KEYS, "block")] == last:
                cut -= 1
            if cut:
                yield united(table.slice(0, cut), data)
            carried = united(table.slice(cut), True)  # the last block may go on in the next batch
            held, bits = [carried], pc.sum(carried.column("ones")).as_py()
        if held:
            yield united(pa.Table.from_batches(held), data)

    return kernel


def merge(blocks: DataFrame, *, data: bool = True, salts: int = 1) -> DataFrame:
    """Union of bitmaps of one size per grouping, of parts, days or runs alike.  ``data`` false: only the counts of bits.

    ``salts`` > 1 unites in two levels, so that no block has very many parts in one task.
    """
    keys = [*KEYS, "block"]
    out = blocks
    if salts > 1:
        spread = out.withColumn("salt", F.pmod(F.xxhash64("data"), F.lit(salts))).repartition(*keys, "salt").sortWithinPartitions(*keys).drop("salt")
        out = spread.mapInArrow(_union_kernel(True), BLOCKS_DDL)
    return out.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_union_kernel(data), BLOCKS_DDL)


def estimate(blocks: DataFrame, bits: dict[int, int]) -> DataFrame:
    """``entity, by, day, metric, dc, n_distinct, n_error``: the estimate and its standard error (in identifiers).

    A full bitmap has no estimate (null): it was sized for fewer identifiers.
    """
    m = F.element_at(F.create_map(*(F.lit(float(x) if k else int(x)) for e in bits.items() for k, x in enumerate(e))), F.col("by"))
    ones = blocks.groupBy(*KEYS).agg(F.sum("ones").alias("ones")).withColumn("m", m)
    empty = F.col("m") - F.col("ones")
    n = F.when(empty > 0, F.col("m") * F.log(F.col("m") / empty))
    load = F.col("n") / F.col("m")
    spread = F.sqrt(F.greatest(F.col("m") * (F.exp(load) - load - 1), F.lit(0.0)))
    return ones.withColumn("n", n).select(*KEYS, F.round("n").cast("long").alias("n_distinct"), F.round(spread, 2).alias("n_error"))


def distinct_cube(points: DataFrame, *, error: float = 0.01, bits: dict[int, int] | None = None) -> DataFrame:
    """Distinct metrics, tag names, tag values, hosts, traces and sources per day, metric, dc and combination.

    ``entity, by_day, by_metric, by_dc, day, metric, dc, n_distinct, n_error``; the
    by_ columns tell which of the three group, so that a null among the grouping
    values keeps its own row.  ``bits``: sizes by grouping (bits 4 day, 2 metric, 1 dc),
    counted by default; results that are to be merged later need the same ones.
    Empty input gives an empty result.
    """
    bits = bits or sizes_of(points, error)
    parts = partial_bitmaps(points, bits)
    salts = max(1, points.count() // (BUFFER_ROWS * FAN))
    result = estimate(merge(parts, data=False, salts=salts), bits)
    name = F.element_at(F.array(*(F.lit(e) for e in ENTITIES)), F.col("entity") + 1)
    return result.select(name.alias("entity"), *((F.col("by").bitwiseAND(b) > 0).alias(f"by_{c}") for c, b in FLAGS), "day", "metric", "dc", "n_distinct", "n_error")
