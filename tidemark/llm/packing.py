"""Filling containers of fixed capacity with whole texts.

Items are spread at random over blocks of about ``block_items``; each block is
packed on its own: best fit in decreasing order gives a start, then a swap-based
local search moves single items, exchanges one for one and two for one between
underfull bins whenever that raises the sum of squared fills, until bins empty.
Bins that stay underfull are opened again and their items go through further
rounds with fewer blocks, down to one.  A pack whose round closes hardly any of
its bins keeps only the emptiest ones open and halves its blocks, so that the
rounds come to an end whatever the sizes.  Each round is written to the shared folder.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

BINS_DDL = "pack_name STRING, capacity INT, bin_id BIGINT, doc_id BIGINT, piece INT, n_tokens INT, open INT"
PACKED_DDL = "pack_name STRING, bin_id BIGINT, doc_id BIGINT, piece INT, n_tokens INT"
#: Kinds of containers that are packed together.
KINDS = 1000
#: A round is a stall if it leaves more than this share of the bins that were open before.
STALLED = 0.9


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers), best fit in decreasing order of size; sizes are at most ``capacity``."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free tokens, bin), ascending
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free > size or not size:
            insort(room, (free - size, b))
    return bins


class Search:
    """Local search over underfull bins; every accepted step raises the sum of squared fills."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes.tolist(), capacity
        self.bins = [list(b) for b in bins]
        self.fill = [sum(self.sizes[i] for i in b) for b in self.bins]

    def _take(self, source: int, target: int, out: list[int], back: list[int]) -> None:
        for i in out:
            self.bins[source].remove(i)
            self.bins[target].append(i)
        for i in back:
            self.bins[target].remove(i)
            self.bins[source].append(i)
        moved = sum(self.sizes[i] for i in out) - sum(self.sizes[i] for i in back)
        self.fill[source] -= moved
        self.fill[target] += moved

    def _step(self, source: int, target: int) -> bool:
        """One exchange that moves tokens from the emptier ``source`` to ``target``."""
        sizes, free = self.sizes, self.capacity - self.fill[target]
        if free <= 0 or source == target:
            return False
        mine = sorted((i for i in self.bins[source] if sizes[i]), key=lambda i: -sizes[i])
        best: tuple[int, list[int], list[int]] | None = None
        for a in mine:  # move
            if sizes[a] <= free:
                best = (sizes[a], [a], [])
                break
        theirs = sorted(self.bins[target], key=lambda i: sizes[i])
        keys = [sizes[i] for i in theirs]
        for a in mine:  # one for one: the smallest item of the target that makes room
            at = bisect_left(keys, sizes[a] - free)
            if at < len(keys) and 0 < sizes[a] - keys[at] and (best is None or sizes[a] - keys[at] > best[0]):
                best = (sizes[a] - keys[at], [a], [theirs[at]])
        if best is not None and best[0] == free:
            self._take(source, target, best[1], best[2])
            return True
        for k, a in enumerate(mine):  # two for one, either way
            for b in mine[k + 1 :]:
                pair = sizes[a] + sizes[b]
                at = bisect_left(keys, pair - free)
                if at < len(keys) and 0 < pair - keys[at] and (best is None or pair - keys[at] > best[0]):
                    best = (pair - keys[at], [a, b], [theirs[at]])
            for j, small in enumerate(keys):
                if small >= sizes[a]:
                    break
                at = bisect_left(keys, sizes[a] - free - small, j + 1)
                if at < len(keys) and 0 < sizes[a] - small - keys[at] and (best is None or sizes[a] - small - keys[at] > best[0]):
                    best = (sizes[a] - small - keys[at], [a], [theirs[j], theirs[at]])
        if best is None:
            return False
        self._take(source, target, best[1], best[2])
        return True

    def run(self, tries: int) -> list[list[int]]:
        """At most ``tries`` pairs of bins are looked at; the result is complete at any point."""
        alive = sorted((b for b in range(len(self.bins)) if self.fill[b] < self.capacity), key=lambda b: self.fill[b])
        while len(alive) > 1 and tries > 0:
            source, changed = alive[0], False
            for target in reversed(alive[1:]):
                tries -= 1
                if self.fill[target] >= self.fill[source] and self._step(source, target):
                    changed = True
                if tries <= 0 or not any(self.sizes[i] for i in self.bins[source]):
                    break
            if self.fill[source] == 0 and self.bins[source]:  # empty texts need no room
                self.bins[alive[-1]] += self.bins[source]
                self.bins[source] = []
            if not changed or not self.bins[source]:
                alive = alive[1:]
            alive = sorted((b for b in alive if self.bins[b] and self.fill[b] < self.capacity), key=lambda b: self.fill[b])
        return [b for b in self.bins if b]


def pack_items(sizes: np.ndarray, capacity: int, *, tries: int = 20_000) -> list[list[int]]:
    """Bins of item numbers; every item (at most ``capacity``) in exactly one bin."""
    return Search(sizes, best_fit(sizes, capacity), capacity).run(tries)


def _pack_group(base: int, keep_share: float, tries: int):
    """Packs one block.  ``open``: 0 closed, 1 underfull, 2 underfull and at most half full or the emptiest of the block."""

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        capacity, block, last = int(x["capacity"].iloc[0]), int(x["block"].iloc[0]), int(x["blocks"].iloc[0]) == 1
        x = x.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = x["n_tokens"].to_numpy(np.int64)
        bins = pack_items(sizes, capacity, tries=tries)
        fills = [int(sizes[items].sum()) for items in bins]
        low = max(capacity // 2, min(fills))
        bin_of, open_ = np.zeros(len(x), np.int64), np.zeros(len(x), np.int32)
        for k, (items, fill) in enumerate(zip(bins, fills)):
            bin_of[items] = ((base + block) << 24) | k
            open_[items] = 0 if last or fill >= keep_share * capacity else 2 if fill <= low else 1
        return x.assign(bin_id=bin_of, open=open_)[["pack_name", "capacity", "bin_id", "doc_id", "piece", "n_tokens", "open"]]

    return pack


def pack_texts(
    sizes: DataFrame,
    packs: DataFrame,
    *,
    block_items: int = 8_000,
    keep_share: float = 0.995,
    tries: int = 20_000,
) -> DataFrame:
    """``pack_name, bin_id, doc_id, piece, n_tokens``: every text in bins of each capacity.

    sizes: doc_id, n_tokens; packs: pack_name, capacity (rows with a positive one count;
    a thousand at a time, as every text goes into every kind of container).  A text is split only if it is larger than
    the capacity: into pieces of exactly the capacity and one remainder.  Texts
    without tokens take no room but have a row.  Null n_tokens counts as 0.
    """
    kinds = packs.where((F.col("capacity") > 0) & F.col("pack_name").isNotNull()).select("pack_name", "capacity").distinct().orderBy("pack_name", "capacity").collect()
    if not kinds:
        return sizes.sparkSession.createDataFrame([], PACKED_DDL)
    out = None
    for lo in range(0, len(kinds), KINDS):
        one = _pack_kinds(sizes, kinds[lo : lo + KINDS], block_items, keep_share, tries)
        out = one if out is None else out.unionByName(one)
    return out


def _pack_kinds(sizes: DataFrame, kinds: list, block_items: int, keep_share: float, tries: int) -> DataFrame:
    """The rounds for some kinds of containers together."""
    n, c = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("int"), F.col("k.capacity")
    kind = F.array(*(F.struct(F.lit(k.pack_name).alias("pack_name"), F.lit(int(k.capacity)).alias("capacity")) for k in kinds))
    pieces = (
        sizes.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), F.explode(kind).alias("k"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / c).cast("int") - 1, F.lit(0)))))
        .select("k.pack_name", "k.capacity", "doc_id", "piece", F.least(F.col("n") - F.col("piece") * c, c).cast("int").alias("n_tokens"))
    )
    left, closed, number, base = cut(pieces), None, 0, 0
    blocks = {r[0]: max(1, -(-r[1] // block_items)) for r in left.groupBy("pack_name").count().collect()}
    if not blocks:
        return sizes.sparkSession.createDataFrame([], PACKED_DDL)
    opened: dict[str, int] = {}
    while True:
        spread = F.broadcast(sizes.sparkSession.createDataFrame(list(blocks.items()), "pack_name STRING, blocks INT"))
        packed = cut(
            left.join(spread, "pack_name")
            .withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(number)), F.col("blocks")).cast("int"))
            .groupBy("pack_name", "block")
            .applyInPandas(_pack_group(base, keep_share, tries), BINS_DDL)
        )
        state = packed.where("open > 0").groupBy("pack_name").agg(F.countDistinct("bin_id"), F.count("*"), F.count_if(F.col("open") == 2)).collect()
        stalled = {name for name, bins, *_ in state if bins > STALLED * opened.get(name, float("inf"))}
        again = F.col("open") > F.when(F.col("pack_name").isin(*stalled), 1).otherwise(0) if stalled else F.col("open") > 0
        done = packed.where(~again)
        closed = done if closed is None else closed.unionByName(done)
        if not state:
            return closed.select("pack_name", "bin_id", "doc_id", "piece", "n_tokens")
        base, number = base + max(blocks.values()), number + 1
        left = packed.where(again).drop("open", "bin_id")
        opened = {name: bins for name, bins, *_ in state}
        blocks = {
            name: max(1, min(-(-(low if name in stalled else pieces) // block_items), blocks[name] // 2 if name in stalled else blocks[name]))
            for name, _, pieces, low in state
        }


def fill_summary(bins: DataFrame, packs: DataFrame) -> DataFrame:
    """Per container: ``n_bins``, the least number of bins any packing needs, and the share of room used."""
    per = bins.groupBy("pack_name").agg(F.countDistinct("bin_id").alias("n_bins"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_pieces"))
    return per.join(packs.select("pack_name", "capacity").distinct(), "pack_name").select(
        "pack_name", "n_pieces", "n_bins",
        F.ceil(F.col("tokens") / F.col("capacity")).cast("long").alias("least_bins"),
        F.round(F.col("tokens") / (F.col("n_bins") * F.col("capacity")), 4).alias("used_share"),
    )
