"""Gradient boosted trees for two classes, small and dependency-free."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic gradient boosting over binned features; deterministic for the same data."""

    def __init__(self, rounds: int = 50, depth: int = 3, rate: float = 0.25, bins: int = 16, least: int = 4):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.asarray(x, dtype=np.float64)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - prob, prob * (1 - prob), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self.rate * self._values(tree, x)
        return self

    def _grow(self, b, g, h, idx, depth):
        total_g, total_h = g[idx].sum(), h[idx].sum()
        leaf = float(total_g / (total_h + 1.0))
        if depth == 0 or len(idx) < 2 * self.least:
            return leaf
        best = (1e-6, -1, 0)
        base = total_g**2 / (total_h + 1.0)
        for j, e in enumerate(self.edges):
            if not len(e):
                continue
            n = len(e) + 1
            hg = np.bincount(b[idx, j], g[idx], n).cumsum()[:-1]
            hh = np.bincount(b[idx, j], h[idx], n).cumsum()[:-1]
            c = np.bincount(b[idx, j], minlength=n).cumsum()[:-1]
            gain = hg**2 / (hh + 1.0) + (total_g - hg) ** 2 / (total_h - hh + 1.0) - base
            gain[(c < self.least) | (len(idx) - c < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] < 0:
            return leaf
        _, j, k = best
        left = b[idx, j] <= k
        return (j, float(self.edges[j][k]), self._grow(b, g, h, idx[left], depth - 1), self._grow(b, g, h, idx[~left], depth - 1))

    def _values(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, left, right = tree
        out = np.empty(len(x))
        m = x[:, j] <= cut
        out[m] = self._values(left, x[m])
        out[~m] = self._values(right, x[~m])
        return out

    def one(self, row) -> float:
        """Probability for one row of features."""
        f = self.start
        for t in self.trees:
            while t.__class__ is tuple:
                t = t[2] if row[t[0]] <= t[1] else t[3]
            f += self.rate * t
        return 1 / (1 + float(np.exp(-f)))
