"""Totals per key where a few keys hold most rows: dense accumulator arrays.

Each task dictionary-encodes the keys of its input split and accumulates into
dense arrays (``bincount`` for counts and sums, scatter-reduce for the last value).
The dictionary is cut into blocks by key hash; a task hands on, per block, one row
with its keys and arrays.  Blocks are then summed in two levels, many of them at once
in a task, so that neither a hot key (one array slot per task) nor a task count in
the thousands makes one task long.  Work per task depends on the rows of its split
only, which Spark cuts to equal bytes; rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS_DDL = (
    "block INT, slot INT, keys ARRAY<STRING>, counts ARRAY<BIGINT>, filled ARRAY<BIGINT>, "
    "sums ARRAY<DOUBLE>, last_at ARRAY<BIGINT>, last_tie ARRAY<BIGINT>, last_value ARRAY<DOUBLE>"
)
TOTALS_DDL = "key STRING, n_rows BIGINT, n_values BIGINT, total DOUBLE, last_value DOUBLE"
LOWEST = np.iinfo(np.int64).min


def _block_of(keys: pa.Array, blocks: int) -> np.ndarray:
    import zlib

    return np.array([0 if k is None else zlib.crc32(k.encode()) % blocks for k in keys.to_pylist()], dtype=np.int64)


class Accumulator:
    """Dense arrays over a growing dictionary of keys."""

    def __init__(self) -> None:
        self.index: dict[str | None, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.filled = np.zeros(0, np.int64)
        self.sums = np.zeros(0, np.float64)
        self.last = np.zeros(0, dtype=[("at", np.int64), ("tie", np.int64), ("value", np.float64)])

    def slots(self, keys: list[str | None]) -> np.ndarray:
        index = self.index
        found = np.array([index.setdefault(k, len(index)) for k in keys], dtype=np.int64)
        if (more := len(index) - len(self.counts)) > 0:
            self.counts = np.append(self.counts, np.zeros(more, np.int64))
            self.filled = np.append(self.filled, np.zeros(more, np.int64))
            self.sums = np.append(self.sums, np.zeros(more))
            fresh = np.zeros(more, self.last.dtype)
            fresh["at"] = fresh["tie"] = LOWEST
            fresh["value"] = np.nan
            self.last = np.append(self.last, fresh)
        return found

    def add(self, slot, counts, filled, sums, at, tie, value) -> None:
        """Add to slots; ``counts`` None counts rows.  Rows without a value must have sums of 0 and LOWEST times."""
        size = len(self.counts)
        if counts is None:
            self.counts += np.bincount(slot, minlength=size)
        else:
            np.add.at(self.counts, slot, counts)
        if at is None:
            return
        np.add.at(self.filled, slot, filled)
        self.sums += np.bincount(slot, weights=sums, minlength=size)
        order = np.lexsort((tie, at, slot))
        s = slot[order]
        end = np.flatnonzero(np.append(s[1:] != s[:-1], True))
        rows, s = order[end], s[end]
        own = self.last[s]
        newer = (at[rows] > own["at"]) | ((at[rows] == own["at"]) & (tie[rows] > own["tie"]))
        s, rows = s[newer], rows[newer]
        self.last["at"][s], self.last["tie"][s], self.last["value"][s] = at[rows], tie[rows], value[rows]

    def rows(self, blocks: int, slot: int) -> pa.RecordBatch | None:
        if not self.index:
            return None
        keys = pa.array(list(self.index), pa.string())
        of = _block_of(keys, blocks)
        order = np.argsort(of, kind="stable")
        used, start = np.unique(of[order], return_index=True)
        offsets = pa.array(np.append(start, len(order)), pa.int32())
        as_list = lambda a: pa.ListArray.from_arrays(offsets, a)
        numbers = [self.counts, self.filled, self.sums, self.last["at"], self.last["tie"], self.last["value"]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.array(np.full(len(used), slot), pa.int32()),
                as_list(keys.take(pa.array(order))),
                *(as_list(pa.array(np.ascontiguousarray(a)[order])) for a in numbers),
            ],
            names=[f.split()[0] for f in BLOCKS_DDL.split(", ")],
        )


def _encode(blocks: int, fan: int, most_keys: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        slot = (context.partitionId() if context else 0) % fan
        acc = Accumulator()
        for batch in batches:
            column = batch.column(0)
            parent = None
            if pa.types.is_list(column.type):
                parent = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
                column = pc.list_flatten(column)
            coded = pc.dictionary_encode(column, null_encoding="encode")
            local = acc.slots(coded.dictionary.to_pylist())
            at = coded.indices.to_numpy(zero_copy_only=False)
            if batch.num_columns == 1:
                seen = np.bincount(at, minlength=len(local))
                acc.add(local, seen, None, None, None, None, None)
            else:
                value, when, tie = (batch.column(k) for k in (1, 2, 3))
                there = pc.is_valid(value).to_numpy(zero_copy_only=False)
                value = value.to_numpy(zero_copy_only=False).astype(np.float64)
                when = np.where(there, pc.fill_null(when, LOWEST + 1).to_numpy(zero_copy_only=False), LOWEST)
                tie = np.where(there, pc.fill_null(tie, LOWEST + 1).to_numpy(zero_copy_only=False), LOWEST)
                if parent is not None:
                    there, value, when, tie = there[parent], value[parent], when[parent], tie[parent]
                if len(at):
                    acc.add(local[at], None, there.astype(np.int64), np.where(there, value, 0.0), when, tie, value)
            if len(acc.index) > most_keys:
                yield acc.rows(blocks, slot)
                acc = Accumulator()
        if (out := acc.rows(blocks, slot)) is not None:
            yield out

    return kernel


def _add_blocks(acc: Accumulator, batch: pa.RecordBatch) -> None:
    flat = {n: pc.list_flatten(batch.column(n)) for n in ("keys", "counts", "filled", "sums", "last_at", "last_tie", "last_value")}
    coded = pc.dictionary_encode(flat["keys"], null_encoding="encode")
    slot = acc.slots(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    num = {n: flat[n].to_numpy(zero_copy_only=False) for n in list(flat)[1:]}
    acc.add(slot, num["counts"], num["filled"], num["sums"], num["last_at"], num["last_tie"], num["last_value"])


def _level(blocks: int, most_keys: int):
    """Sums whatever blocks a task gets; partial sums may go out early."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = Accumulator()
        for batch in batches:
            if batch.num_rows:
                _add_blocks(acc, batch)
            if len(acc.index) > most_keys:
                yield acc.rows(blocks, 0)
                acc = Accumulator()
        if (out := acc.rows(blocks, 0)) is not None:
            yield out

    return kernel


def _last(most_keys: int):
    """Totals of whole blocks; rows arrive sorted by block, so that the keys of finished blocks need not be kept."""

    def totals(acc: Accumulator) -> pa.RecordBatch:
        known = acc.filled > 0
        columns = {
            "key": pa.array(list(acc.index), pa.string()),
            "n_rows": pa.array(acc.counts),
            "n_values": pa.array(acc.filled),
            "total": pa.array(np.where(known, acc.sums, 0.0)),
            "last_value": pa.array(np.ascontiguousarray(acc.last["value"]), mask=~known),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, open_block = Accumulator(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            if len(acc.index) > most_keys:  # hand on what is finished
                same = int(np.argmax(block != open_block)) if (block != open_block).any() else len(block)
                if same:
                    _add_blocks(acc, batch.slice(0, same))
                if same == len(block):
                    continue
                yield totals(acc)
                acc, batch = Accumulator(), batch.slice(same)
            _add_blocks(acc, batch)
            open_block = block[-1]
        if acc.index:
            yield totals(acc)

    return kernel


def dense_totals(
    df: DataFrame,
    key: str,
    *,
    value: str | None = None,
    at: str | None = None,
    tie: str | None = None,
    blocks: int = 4096,
    fan: int = 32,
    most_keys: int = 200_000,
) -> DataFrame:
    """Per key: ``n_rows``, ``n_values`` (rows with a value), ``total`` and ``last_value``.

    ``key`` is a string column, or an array of strings whose entries each count.
    Null keys are a key of their own (null), entries of a null or empty array count
    for nothing.  The last value is that of the greatest (``at``, ``tie``), nulls
    lowest.  Without ``value`` only ``n_rows`` is counted, the others are 0 and null.
    Sums are in double; NaN and infinities go into them as they are.  A task of the
    last level holds the keys of one block, and those of others up to ``most_keys``.
    Empty input gives an empty result.
    """
    columns = [F.col(key).alias("key")]
    if value is not None:
        columns += [
            F.col(value).cast("double").alias("value"),
            (F.col(at).cast("long") if at else F.lit(0).cast("long")).alias("at"),
            (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("tie"),
        ]
    parts = df.select(*columns).mapInArrow(_encode(blocks, fan, most_keys), BLOCKS_DDL)

    summed = parts.repartition("block", "slot").mapInArrow(_level(blocks, most_keys), BLOCKS_DDL)
    return summed.repartition("block").sortWithinPartitions("block").mapInArrow(_last(most_keys), TOTALS_DDL)


def heavy_keys(points: DataFrame, *, share_percent: int = 6) -> DataFrame:
    """Metrics and tag names that hold at least ``share_percent`` of all rows or of all tag entries.

    ``field`` is ``metric`` or ``name``.  All rows count, those with a null metric
    too, but null is never reported as a key.
    """
    totals = None
    for field, column in (("metric", F.col("metric")), ("name", F.map_keys("tags"))):
        one = dense_totals(points.select(column.alias("key")), "key").withColumn("field", F.lit(field))
        totals = one if totals is None else totals.unionByName(one)
    everything = totals.groupBy("field").agg(F.sum("n_rows").alias("all_rows"))
    heavy = F.col("key").isNotNull() & (F.col("n_rows") * 100 >= F.col("all_rows") * share_percent)
    return totals.join(everything, "field").where(heavy).select("field", F.col("key").alias("key_name"))
