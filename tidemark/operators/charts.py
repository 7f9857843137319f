"""Numpy kernels of the robust control charts: padded (series, time) matrices.

All kernels work on a float64 matrix ``v`` of shape (series, time) whose rows are
left-aligned, and ``n``, the number of valid cells of each row.  Nothing here knows
of Spark; ``tidemark.operators.anomalies`` feeds the kernels from Arrow batches.
"""

from __future__ import annotations

import numpy as np


def reverse_rows(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each row's valid part backwards, still left-aligned."""
    width = v.shape[1]
    at = n[:, None] - 1 - np.arange(width)[None, :]
    return np.where(at >= 0, np.take_along_axis(v, np.clip(at, 0, width - 1), axis=1), np.nan)


def masked_median(a: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Row-wise lower/upper-averaged median of the kept cells, nan where none is kept."""
    s = np.sort(np.where(keep, a, np.inf), axis=1)
    k = keep.sum(axis=1)
    rows = np.arange(len(a))
    lo, hi = np.maximum((k - 1) // 2, 0), np.minimum(k // 2, a.shape[1] - 1)
    with np.errstate(invalid="ignore"):
        return np.where(k > 0, (s[rows, lo] + s[rows, hi]) / 2, np.nan)


def typical_step(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median size of the non-zero steps between successive readings (0 where there is none).

    It is one quantum for coarsely rounded sources and about one standard
    deviation for noisy ones, and thus a floor for the scale of the chart.
    """
    if v.shape[1] < 2:
        return np.zeros(len(v))
    step = np.abs(np.diff(v, axis=1))
    keep = (np.arange(1, v.shape[1])[None, :] < n[:, None]) & (step > 0)
    return np.nan_to_num(masked_median(np.nan_to_num(step), keep))


def ew_chart(v, n, floor, *, alpha=0.15, beta=0.06, suspect=5.5, clip=2.5, warm=15, rebase=5):
    """Centre and scale of the chart just before each reading.

    Exponentially weighted mean and scale; a reading further than ``suspect``
    scales away is held out of both, others enter clipped to ``clip`` scales.  A
    run of ``rebase`` suspected readings is a new level: the centre moves to the
    median of that run.  The chart starts from median and MAD of ``warm`` readings.
    """
    s, width = v.shape
    head = v[:, :warm]
    keep = np.arange(head.shape[1])[None, :] < n[:, None]
    mean = np.nan_to_num(masked_median(np.nan_to_num(head), keep))
    dev = masked_median(np.nan_to_num(np.abs(head - mean[:, None])), keep)
    scale = np.maximum(1.4826 * np.nan_to_num(dev), floor)
    run = np.zeros(s, dtype=np.int64)
    means, scales = np.empty_like(v), np.empty_like(v)
    for t in range(width):
        means[:, t], scales[:, t] = mean, scale
        live = t < n
        e = np.where(live, v[:, t], mean) - mean
        far = np.abs(e) > suspect * scale
        run = np.where(live, np.where(far, run + 1, 0), run)
        moved = run >= rebase
        used = np.clip(e, -clip * scale, clip * scale)
        mean = np.where(far, mean, mean + alpha * used)
        scale = np.where(far | ~live, scale, np.maximum((1 - beta) * scale + beta * 1.2533 * np.abs(used), floor))
        if moved.any():
            mean[moved] = np.median(v[moved, t - rebase + 1 : t + 1], axis=1)
            run[moved] = 0
    return means, scales


def two_way(v, n, *, relative_floor=1e-3, step_floor=0.7, **chart):
    """Centre and scale of the forward chart, then of the backward chart, for each cell."""
    valid = np.arange(v.shape[1])[None, :] < n[:, None]
    size = np.nan_to_num(masked_median(np.nan_to_num(np.abs(v)), valid))
    floor = np.maximum(np.maximum(step_floor * typical_step(v, n), relative_floor * size), 1e-12)
    ahead = ew_chart(v, n, floor, **chart)
    back = ew_chart(reverse_rows(v, n), n, floor, **chart)
    return (*ahead, *(reverse_rows(x, n) for x in back))


def stands_out(v, mean, scale, mean_back, scale_back):
    """Distance in scales on which both directions agree, 0 where their signs differ.

    A change of level is far for one direction only, as is the start of a noisier
    phase; only readings that stand out from both sides keep a high score.
    """
    a, b = (v - mean) / scale, (v - mean_back) / scale_back
    return np.where(np.sign(a) == np.sign(b), np.minimum(np.abs(a), np.abs(b)), 0.0)


def beside(hit):
    """Cells next to a hit one in their row, hits included."""
    out = hit.copy()
    out[:, 1:] |= hit[:, :-1]
    out[:, :-1] |= hit[:, 1:]
    return out


def run_lengths(v, n):
    """(length of the run of equal values a cell lies in, number of its run within the row)."""
    s, width = v.shape
    valid = np.arange(width)[None, :] < n[:, None]
    new = np.ones((s, width), dtype=bool)
    if width > 1:
        new[:, 1:] = (v[:, 1:] != v[:, :-1]) | ~valid[:, 1:]
    run = np.cumsum(new, axis=1) - 1
    flat = run + np.arange(s)[:, None] * width
    size = np.bincount(flat[valid], minlength=s * width)
    return np.where(valid, size[flat], 0), run


def frozen(v, n, *, least=8, usual_share=0.5, chance=1e-4):
    """Cells in stretches of equal values far longer than the rest of the row explains.

    The row's normal behaviour is read off its runs shorter than ``least``: they
    must hold at least ``usual_share`` of the readings (sources that are constant,
    keep levels or are coarsely rounded do not pass), and with the repeat rate
    seen in them a run of the observed length must be less likely than ``chance``.
    """
    length, run = run_lengths(v, n)
    valid = np.arange(v.shape[1])[None, :] < n[:, None]
    short = valid & (length < least)
    rest = short.sum(axis=1)
    first = np.ones_like(valid)
    first[:, 1:] = run[:, 1:] != run[:, :-1]
    runs = (short & first).sum(axis=1)
    repeat = np.clip((rest - runs + 1) / np.maximum(rest + 2, 1), 1e-6, 1)
    likely = np.log(np.maximum(n, 1))[:, None] + (length - 1) * np.log(repeat)[:, None]
    return (length >= least) & (rest >= usual_share * np.maximum(n, 1))[:, None] & (likely < np.log(chance))
