import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing
from tidemark.llm.packing import Search, best_fit, fill_summary, pack_items, pack_texts


def whole(sizes, bins, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(int(sizes[i]) for i in b) <= capacity for b in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 120))
def test_items_are_kept_and_bins_hold(sizes, capacity):
    v = np.array(sizes, np.int64)
    bins = pack_items(v, capacity)
    whole(v, bins, capacity)
    assert len(bins) <= len(best_fit(v, capacity))


def test_search_empties_bins():
    # best fit decreasing needs three bins, two suffice
    sizes = np.array([6, 5, 5, 4, 4, 4, 2][:6] + [2], np.int64)
    first = [[0], [1], [2], [3], [4], [5], [6]]
    search = Search(sizes, first, 15)
    bins = search.run(10_000)
    whole(sizes, bins, 15)
    assert len(bins) == 2


def test_search_raises_squared_fill():
    rng = np.random.default_rng(0)
    sizes = rng.integers(20, 60, 200)
    first = [[i] for i in range(200)]
    bins = Search(sizes, first, 100).run(5_000)
    whole(sizes, bins, 100)
    fill = [sum(sizes[i] for i in b) for b in bins]
    assert sum(f * f for f in fill) > sum(int(s) ** 2 for s in sizes) and len(bins) < 110


SIZES = "doc_id BIGINT, n_tokens BIGINT, bin_id STRING, piece STRING"


def test_operator(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(n), "x", "y") for k, n in enumerate(rng.geometric(0.02, 900))] + [(900, 0, None, None), (901, None, None, None), (902, 1000, None, None), (903, 256, None, None)]
    packs = spark.createDataFrame([("small", 256), ("small", 256), ("tiny", 64), ("none", None), (None, 5)], "pack_name STRING, capacity INT")
    got = pack_texts(spark.createDataFrame(rows, SIZES), packs, block_items=200).collect()
    for name, capacity in (("small", 256), ("tiny", 64)):
        mine = [r for r in got if r.pack_name == name]
        fill, docs = {}, {}
        for r in mine:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
            docs.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
        assert max(fill.values()) <= capacity and docs.keys() == {r[0] for r in rows}
        for k, n, *_ in rows:
            pieces = sorted(docs[k])
            assert [p for p, _ in pieces] == list(range(len(pieces))) and sum(s for _, s in pieces) == (n or 0)
            assert len(pieces) == max(1, -(-(n or 0) // capacity)) and all(s == capacity for _, s in pieces[:-1])
        total = sum(n or 0 for _, n, *_ in rows)
        assert len(fill) <= -(-total // capacity) + 2
    s = {r.pack_name: r for r in fill_summary(spark.createDataFrame(got), packs.where("pack_name is not null")).collect()}
    assert s["small"].used_share > 0.98


def bins_of(got, n, capacity):
    rows = got.collect()
    assert sorted((r.doc_id, r.piece) for r in rows) == [(k, 0) for k in range(n)]
    fill = {}
    for r in rows:
        fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
    assert max(fill.values()) <= capacity and min(fill) >= 0
    return fill


@pytest.mark.parametrize("size, capacity, most", [("154", 256, 100_000), ("case when id % 50 = 0 then 20 else 154 end", 256, 98_000), ("30", 100, 33_335), ("1", 1_000_000, 1), ("0", 256, 1)])
def test_rounds_end_when_bins_stay_open(spark, size, capacity, most):
    packs = spark.createDataFrame([("a", capacity)], "pack_name STRING, capacity INT")
    got = pack_texts(spark.range(100_000).selectExpr("id as doc_id", f"cast({size} as bigint) as n_tokens"), packs)
    assert len(bins_of(got, 100_000, capacity)) <= most


def test_empty_and_bad_input(spark):
    packs = spark.createDataFrame([("small", 256)], "pack_name STRING, capacity INT")
    nothing = spark.createDataFrame([], SIZES)
    assert pack_texts(nothing, packs).collect() == []
    assert pack_texts(nothing, packs.limit(0)).collect() == []


def test_kinds_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "KINDS", 2)
    packs = spark.createDataFrame([(c, k) for c, k in zip("abcde", (10, 20, 30, 40, 50))], "pack_name STRING, capacity INT")
    got = pack_texts(spark.createDataFrame([(k, 7, None, None) for k in range(40)], SIZES), packs).collect()
    for name, least in zip("abcde", (40, 20, 10, 8, 6)):
        assert len({r.bin_id for r in got if r.pack_name == name}) == least and sorted(r.doc_id for r in got if r.pack_name == name) == list(range(40))
