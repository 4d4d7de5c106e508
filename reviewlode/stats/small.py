"""Exact tests and resampling on the driver, from counts."""

from __future__ import annotations

import math

import numpy as np


def _log_hyper(a: int, r1: int, r2: int, c1: int) -> float:
    def choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    return choose(r1, a) + choose(r2, c1 - a) - choose(r1 + r2, c1)


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float | None, float]:
    """Odds ratio and two-sided p of a 2x2 table; the ratio is infinite or null (0/0) with empty cells."""
    odds = a * d / (b * c) if b * c else (math.inf if a * d else None)
    r1, r2, c1 = a + b, c + d, a + c
    if not r1 or not r2 or not c1 or not (b + d):
        return odds, 1.0
    here = _log_hyper(a, r1, r2, c1)
    lo, hi = max(0, c1 - r2), min(r1, c1)
    p = sum(math.exp(v) for x in range(lo, hi + 1) if (v := _log_hyper(x, r1, r2, c1)) <= here + 1e-7)
    return odds, min(1.0, p)


def bootstrap_difference(a: dict[float, int], b: dict[float, int], times: int = 2000, seed: int = 0) -> tuple[float, float, float] | None:
    """Difference of means with a percentile interval; values are resampled through their counts.  None if a side is empty."""
    if not sum(a.values()) or not sum(b.values()):
        return None
    r = np.random.default_rng(seed)

    def means(h):
        v, n = np.array(list(h), float), np.array(list(h.values()), float)
        return (r.multinomial(int(n.sum()), n / n.sum(), size=times) @ v) / n.sum()

    def mean(h):
        return sum(k * n for k, n in h.items()) / sum(h.values())

    lo, hi = np.percentile(means(a) - means(b), [2.5, 97.5])
    return mean(a) - mean(b), float(lo), float(hi)


def bimodality(counts: dict[float, int]) -> float | None:
    """Bimodality coefficient from counts; null under four values or without spread."""
    v, n = np.array(list(counts), float), np.array(list(counts.values()), float)
    t = n.sum()
    if t < 4:
        return None
    m = (v * n).sum() / t
    s2 = ((v - m) ** 2 * n).sum() / t
    if s2 == 0:
        return None
    skew = ((v - m) ** 3 * n).sum() / t / s2**1.5
    kurt = ((v - m) ** 4 * n).sum() / t / s2**2 - 3
    return float((skew**2 + 1) / (kurt + 3 * (t - 1) ** 2 / ((t - 2) * (t - 3))))


def dip(counts: dict[float, int]) -> float:
    """Hartigans' dip of a distribution given by counts: its least distance to a unimodal one, which may have an atom at its mode.

    With the mode at a value, the best distribution is convex before and concave
    after it; half the largest gap between the steps and their convex minorant
    or concave majorant is the distance.  Values are few, so each is tried.
    """
    items = sorted((float(k), n) for k, n in counts.items() if n)
    total = sum(n for _, n in items)
    if len(items) < 2:
        return 1 / (2 * total) if total else 0.0
    x = np.array([k for k, _ in items])
    up = np.cumsum([n for _, n in items]) / total
    low = np.concatenate([[0.0], up[:-1]])

    def minorant(xs, ys):
        hull: list[tuple[float, float]] = []
        for p in zip(xs, ys):
            while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0]) >= (p[1] - hull[-2][1]) * (hull[-1][0] - hull[-2][0]):
                hull.pop()
            hull.append(p)
        return np.interp(xs, [h[0] for h in hull], [h[1] for h in hull])

    def gap(xs, lows, ups):
        """The half before the mode, which is the last value and may jump."""
        g = minorant(xs, lows)
        need = np.append(ups[:-1], lows[-1])
        return float(np.max(need - g))

    best = math.inf
    for m in range(len(x)):
        before = gap(x[: m + 1], low[: m + 1], up[: m + 1])
        after = gap(-x[m:][::-1], 1 - up[m:][::-1], 1 - low[m:][::-1])
        best = min(best, max(before, after))
    return max(best / 2, 1 / (2 * total))


def weighted_precision_interval(strata: list[tuple[int, int, float]], times: int = 5000, seed: int = 0) -> tuple[float, float] | None:
    """Percentile interval of the weighted precision of (right, drawn, weight) strata, each resampled within itself."""
    strata = [s for s in strata if s[1]]
    if not strata:
        return None
    r = np.random.default_rng(seed)
    w = np.array([s[2] for s in strata])
    draws = np.stack([r.binomial(n, k / n, size=times) / n for k, n, _ in strata])
    lo, hi = np.percentile(w @ draws / w.sum(), [2.5, 97.5])
    return float(lo), float(hi)


def trend_band(x: list[float], y: list[float], at: list[float], times: int = 400, seed: int = 0) -> list[tuple[float, float, float]] | None:
    """Fitted line at given places with a percentile band from resampled points; None under three points or without spread."""
    a, b = np.array(x, float), np.array(y, float)
    if len(a) < 3 or np.ptp(a) == 0:
        return None
    r = np.random.default_rng(seed)
    slope, cut = np.polyfit(a, b, 1)
    lines = []
    for _ in range(times):
        i = r.integers(0, len(a), len(a))
        if np.ptp(a[i]):
            m, c = np.polyfit(a[i], b[i], 1)
            lines.append(m * np.array(at) + c)
    lo, hi = np.percentile(lines, [2.5, 97.5], axis=0)
    return [(float(slope * p + cut), float(u), float(v)) for p, u, v in zip(at, lo, hi)]
