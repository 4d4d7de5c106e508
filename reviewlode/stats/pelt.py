"""Pruned exact linear time change point detection with a radial basis kernel cost, after Killick, Fearnhead and Eckley (2012)."""

from __future__ import annotations

import numpy as np


def kernel(x: np.ndarray) -> np.ndarray:
    """Gram matrix with the bandwidth from the median squared distance."""
    d = (x[:, None] - x[None, :]) ** 2
    off = d[np.triu_indices(len(x), 1)]
    med = float(np.median(off)) if len(off) else 0.0
    return np.exp(-np.clip(d * (1.0 / med if med > 0 else 1.0), 0.01, 100))


def pelt(x: np.ndarray, penalty: float = 3.0, least: int = 6) -> list[int]:
    """Indices where new segments start; none for short or empty series."""
    n = len(x)
    if n < 2 * least:
        return []
    k = kernel(np.asarray(x, dtype=float))
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = k.cumsum(0).cumsum(1)
    diag = np.concatenate([[0.0], np.diag(k).cumsum()])

    def cost(a, b):
        block = area[b, b] - area[a, b] - area[b, a] + area[a, a]
        return diag[b] - diag[a] - block / (b - a)

    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    last = np.zeros(n + 1, dtype=int)
    candidates = [0]
    for end in range(least, n + 1):
        values = [(best[s] + cost(s, end) + penalty, s) for s in candidates if end - s >= least]
        if values:
            best[end], last[end] = min(values)
            candidates = [s for s in candidates if end - s < least or best[s] + cost(s, end) <= best[end]]
        candidates.append(end - least + 1) if end - least + 1 >= least else None
    cuts, at = [], n
    while at > 0:
        at = int(last[at])
        if at > 0:
            cuts.append(at)
    return cuts[::-1]
