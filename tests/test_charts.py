import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import charts


def score(values):
    v = np.array([values], float)
    n = np.array([len(values)])
    return charts.stands_out(v, *charts.two_way(v, n))[0]


def slow_runs(values):
    out, k = [], 0
    while k < len(values):
        j = k
        while j < len(values) and values[j] == values[k]:
            j += 1
        out += [j - k] * (j - k)
        k = j
    return out


def noise(n, seed=0, size=1.0):
    return 50 + np.random.default_rng(seed).normal(0, size, n)


def test_spike_is_found_from_both_sides():
    for at in (0, 1, 60, 118, 119):
        v = noise(120)
        v[at] += 30
        assert np.flatnonzero(score(v) > 5.5).tolist() == [at]


def test_change_of_level_noisy_phase_and_constants_are_no_spikes():
    v = noise(200)
    v[100:] += 40
    assert not (score(v) > 5.5).any()
    v = noise(200)
    v[100:150] = 50 + (v[100:150] - 50) * 5
    assert (score(v) > 5.5).sum() <= 1
    assert not (score(np.full(80, 3.0)) > 5.5).any()
    assert not (score(np.cumsum(np.full(80, 7.0))) > 5.5).any()


def test_rounded_source_is_judged_by_its_quantum():
    steps = np.repeat([10, 20, 10, 20, 30, 20, 10, 20], 9).astype(float)
    assert not (score(steps) > 5.5).any()
    steps[31] = 190
    assert np.flatnonzero(score(steps) > 5.5).tolist() == [31]


def frozen(values):
    return charts.frozen(np.array([values], float), np.array([len(values)]))[0]


def test_frozen_stretch_with_its_first_reading():
    v = noise(150)
    v[40:60] = v[40]
    assert np.flatnonzero(frozen(v)).tolist() == list(range(40, 60))
    v[110:122] = 0
    assert np.flatnonzero(frozen(v)).tolist() == [*range(40, 60), *range(110, 122)]


def test_constant_level_and_rounded_sources_are_not_frozen():
    assert not frozen(np.full(100, 1.0)).any()
    assert not frozen(np.repeat([1.0, 2.0, 5.0, 3.0], 40)).any()
    assert not frozen(np.repeat(np.random.default_rng(1).integers(0, 4, 60).astype(float), np.random.default_rng(2).integers(1, 14, 60))).any()
    assert not frozen([1.0]).any()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=30), min_size=1, max_size=6))
def test_run_lengths_match_a_loop(rows):
    n = np.array([len(r) for r in rows])
    v = np.full((len(rows), n.max()), np.nan)
    for k, r in enumerate(rows):
        v[k, : len(r)] = r
    length, _ = charts.run_lengths(v, n)
    assert [length[k, : len(r)].tolist() for k, r in enumerate(rows)] == [slow_runs(r) for r in rows]
