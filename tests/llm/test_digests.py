import random
from bisect import bisect_left, bisect_right

import numpy as np
import pytest

from tests.points import frame
from tidemark.llm import digests as D


def test_cluster_keeps_weight_and_size_bound():
    rng = np.random.default_rng(0)
    group = rng.integers(0, 5, 20_000)
    value = rng.normal(0, 1, 20_000)
    g, n, low, high, count, means, weights = D.cluster(group, value, np.ones(20_000, np.int64), value, value, compression=200)
    assert g.tolist() == [0, 1, 2, 3, 4] and weights.sum() == 20_000 and (count <= 102).all()
    for k in range(5):
        own = value[group == k]
        assert n[k] == len(own) and low[k] == own.min() and high[k] == own.max()
    at = D.quantiles(n, low, high, count, means, weights)
    for k in range(5):
        own = np.sort(value[group == k])
        for j, q in enumerate(D.QUANTILES):
            assert abs(np.searchsorted(own, at[k, j]) / len(own) - q) < 0.01


def test_small_groups_are_exact():
    for values in ([5.0], [1.0, 2.0], [1.0, 2.0, 3.0], [7.0] * 9):
        v = np.array(values)
        g, n, low, high, count, means, weights = D.cluster(np.zeros(len(v), int), v, np.ones(len(v), np.int64), v, v)
        x = D.quantiles(n, low, high, count, means, weights)[0]
        assert x[3] == pytest.approx(np.median(v)) and (np.diff(x) >= 0).all() and x[0] >= v.min() and x[-1] <= v.max()


def rows(n=3000):
    rnd = random.Random(1)
    out = []
    for k in range(n):
        m = rnd.choice(["a"] * 6 + ["b", "c", None])
        tags = rnd.choice([None, {}, {"dc": "x", "host": f"h{rnd.randrange(3)}"}, {"port": "1"}])
        kind = rnd.choice(["float_value", "float_value", "int_value", "none"])
        v = rnd.choice([rnd.gauss(0, 1), 5.0, float("nan"), float("inf")]) if kind == "float_value" else rnd.randrange(10**12)
        out.append({"metric": m, "tags": tags, "ts": rnd.choice([10, 86_399, 86_400, 200_000]), kind: v})
    return out


def exact(data):
    groups = {}
    for r in data:
        if r["metric"] is None:
            continue
        f = r.get("float_value")
        f = float(np.float32(f)) if f is not None else None
        joint = float(r["int_value"]) if r.get("int_value") is not None else f
        dims = [("all", None)] + [(d, (r["tags"] or {}).get(d)) for d in D.DIMENSIONS if (r["tags"] or {}).get(d) is not None]
        for field, v in (("float", f), ("joint", joint)):
            if v is not None and np.isfinite(v):
                for dim, value in dims:
                    for day in (r["ts"] // 86400, None):
                        groups.setdefault((field, r["metric"], dim, value, day), []).append(v)
    return {k: sorted(v) for k, v in groups.items()}


@pytest.mark.parametrize("rows_per_part, buffer", [(10**6, 200_000), (100, 200_000), (300, 50), (10**6, 70)])
def test_certified_errors_are_the_true_ones(spark, monkeypatch, rows_per_part, buffer):
    buffers = D._buffers
    monkeypatch.setattr(D, "_buffers", lambda batches: buffers((b.slice(lo, 60) for b in batches for lo in range(0, b.num_rows, 60)), buffer))
    data = rows()
    want = exact(data)
    got = D.certified_percentiles(frame(spark, data, "n INT, day INT, salts INT, estimate STRING").withColumnRenamed("n", "low"), rows_per_part=rows_per_part).collect()
    assert {tuple(r[k] for k in D.KEYS) for r in got} == set(want)
    for r in got:
        v = want[tuple(r[k] for k in D.KEYS)]
        assert r.n == len(v)
        worst = 0.0
        for q in D.QUANTILES:
            x = r[D.percent_name(q)]
            rank = q * len(v)
            worst = max(worst, (bisect_left(v, x) - rank) / len(v), (rank - bisect_right(v, x)) / len(v))
        assert r.rank_error == pytest.approx(worst, abs=1e-12)
        assert worst * len(v) <= 0.01 * len(v) + 1


def test_copies_of_one_point_are_spread_over_the_parts(spark):
    copy = {"metric": "m", "tags": {"dc": "x"}, "ts": 10, "float_value": 1.5}
    df = frame(spark, [copy] * 4000 + [copy | {"ts": k, "float_value": float(k)} for k in range(8000)])
    spread = df.withColumn("salts", D.F.lit(12)).select(D._spread_of(df, "salts").alias("s")).groupBy("s").count().collect()
    assert len(spread) == 12 and max(r["count"] for r in spread) < 1300
    daily = D.daily_digests(df)
    found = D.estimates(daily.unionByName(D.over_all_days(daily)))
    counts = D.rank_counts(df, found, rows_per_part=1000).where("dim = 'all' and field = 'float' and day is null").collect()
    v = sorted([1.5] * 4000 + [float(k) for k in range(8000)])
    p50 = found.where("dim = 'all' and field = 'float' and day is null").first().p50
    assert [(r.below_p50, r.upto_p50) for r in counts] == [(bisect_left(v, p50), bisect_right(v, p50))]


def test_digests_merge_in_any_split(spark):
    data = [{"metric": "m", "tags": {"dc": "x"}, "ts": k % 3 * 86400, "float_value": float(np.float32(np.sin(k) * 1e6))} for k in range(6000)]
    df = frame(spark, data)
    parts = [D.daily_digests(df.where(f"point_id % 3 = {k}")) for k in range(3)]
    merged = D.merge_digests(parts[0].unionByName(parts[1]).unionByName(parts[2]), salts=3)
    total = D.estimates(D.over_all_days(merged)).where("field = 'float' and dim = 'all'").first()
    v = sorted(r["float_value"] for r in data)
    assert total.n == 6000 and all(abs(bisect_left(v, total[D.percent_name(q)]) / 6000 - q) < 0.01 for q in D.QUANTILES)


def test_empty(spark):
    assert D.certified_percentiles(frame(spark, [])).collect() == []
    assert D.certified_percentiles(frame(spark, [{"metric": "m", "tags": None, "ts": None, "float_value": None}])).collect() == []
