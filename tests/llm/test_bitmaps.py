import itertools
import random

import pytest

from tests.points import frame
from tidemark.llm import bitmaps as B


def test_sizing():
    assert B.bits_for(10, 0.5) == 64
    for n in (1, 100, 10_000, 5_000_000):
        bits = B.bits_for(n, 0.01)
        assert B.standard_error(bits, n) <= 0.01 and B.standard_error(bits, 1) <= 0.01
        assert bits == 64 or bits < 4 * n + 20_000
    assert B.standard_error(64, 0) == 0 and B.standard_error(64, 10**9) == float("inf")


def cube(spark, rows, bits, **how):
    return B.estimate(B.merge(B.partial_bitmaps(rows, bits), **how), bits)


def traces(spark, lo, hi, different):
    return spark.range(lo, hi).selectExpr("cast(id % 2 as int) * 86400 as ts", "'m' as metric", f"map('dc', 'x', 'trace', concat('t', id % {different})) as tags")


@pytest.mark.parametrize("n", [1, 50, 3000, 20_000])
def test_estimate_within_its_error(spark, n):
    bits = dict.fromkeys(range(8), B.bits_for(3 * n, 0.01))
    got = cube(spark, traces(spark, 0, 3 * n, n), bits).where("entity = 4 and by = 0").first()
    assert abs(got.n_distinct - n) <= 4 * got.n_error + 1


@pytest.mark.parametrize("bits", [4096, 2**18, 2**20])
def test_union_equals_the_whole(spark, monkeypatch, bits):
    monkeypatch.setattr(B, "BUFFER_BITS", 1000)
    bits = {by: bits for by in range(8)}
    whole = B.merge(B.partial_bitmaps(traces(spark, 0, 30_000, 20_000), bits))
    parts = [B.merge(B.partial_bitmaps(traces(spark, lo, hi, 20_000), bits)) for lo, hi in ((0, 9000), (5000, 21_000), (20_000, 30_000))]
    for salts in (1, 3):
        both = B.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), salts=salts)
        assert both.exceptAll(whole).count() == 0 and whole.exceptAll(both).count() == 0
    assert whole.where("ones >= 4096").count() == whole.where("length(data) = 8192").count()
    bare = B.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), data=False)
    assert sorted(B.estimate(bare, bits).collect(), key=str) == sorted(B.estimate(whole, bits).collect(), key=str)


def test_full_bitmap_has_no_estimate(spark):
    got = cube(spark, traces(spark, 0, 20_000, 20_000), dict.fromkeys(range(8), 64)).where("entity = 4").collect()
    assert got and all(r.n_distinct is None for r in got)


def test_sizes_follow_the_largest_group(spark):
    sizes = B.sizes_of(traces(spark, 0, 5000, 5000))
    assert sizes[0] == B.bits_for(10_000, 0.01) and sizes[4] == sizes[7] == B.bits_for(5000, 0.01)


def test_cube_against_sets(spark):
    rnd = random.Random(2)
    data = [
        {"metric": rnd.choice(["a", "b", None]), "ts": rnd.choice([5, 90_000]), "tags": rnd.choice([None, {}, {"dc": rnd.choice("xy"), "host": f"h{rnd.randrange(9)}", "trace": f"t{k}"}, {"host": "h1", "z": None}])}
        for k in range(1500)
    ]
    want = {}
    for r in data:
        t = r["tags"] or {}
        items = {
            "metrics": {r["metric"]} - {None}, "tag_names": set(t), "tag_values": set(t.values()) - {None}, "hosts": {t.get("host")} - {None}, "traces": {t.get("trace")} - {None},
            "sources": {(r["metric"], tuple(sorted(t.items())))} if r["metric"] is not None and r["tags"] is not None else set(),
        }
        for by in itertools.product((False, True), repeat=3):
            key = (*by, *(v if b else None for b, v in zip(by, (r["ts"] // 86400, r["metric"], t.get("dc")))))
            for entity, found in items.items():
                if found:
                    want.setdefault((entity, *key), set()).update(found)
    got = {tuple(r)[:7]: (r.n_distinct, r.n_error) for r in B.distinct_cube(frame(spark, data, "day INT, dc STRING, entity INT")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - len(want[k])) <= 4 * got[k][1] + 1 for k in want)


def test_empty(spark):
    assert B.distinct_cube(frame(spark, [])).collect() == []
