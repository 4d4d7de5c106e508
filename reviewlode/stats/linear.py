"""Linear models from sufficient statistics: one distributed pass, then small algebra on the driver.

The pass sums, for every cluster, n, X'X, X'y and y'y; a row with a null in any
used column is left out.  Models that cannot be estimated say so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Per-cluster sums: keys, n, xtx (clusters, k, k), xty (clusters, k), yty."""

    keys: list
    n: np.ndarray
    xtx: np.ndarray
    xty: np.ndarray
    yty: np.ndarray
    terms: list[str]


def moments(df: DataFrame, y: str, terms: list[str], cluster: str) -> Moments:
    """Cross products per cluster, summed where the rows are as matrices of Arrow batches, then by (cluster, cell).

    The driver gets the cells of each cluster, so a cluster has to be a group of
    which there are few, such as an app.
    """
    kind = dict(df.dtypes)[cluster]
    rows = df.dropna(subset=[y, *terms, cluster]).select(F.col(cluster).alias("g_"), *[F.col(t).cast("double").alias(f"x{i}") for i, t in enumerate([*terms, y], 1)])
    k = len(terms) + 2  # an intercept before the terms, y after them
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def run(batches):
        sums: dict = {}
        of = None
        for batch in batches:
            of = batch.schema.field(0).type
            keys, where = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            z = np.column_stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]])
            for i, key in enumerate(keys):
                part = z[where == i]
                sums[key] = sums.get(key, 0.0) + part.T @ part
        for key, m in sums.items():
            cells = [float(m[i, j]) for i, j in upper]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(cells), of), pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.float64())], names=["g_", "cell", "v"])

    got = rows.mapInArrow(run, f"g_ {kind}, cell int, v double").groupBy("g_", "cell").agg(F.sum("v").alias("v")).toPandas()
    keys = sorted(got["g_"].unique().tolist())
    full = np.zeros((len(keys), k, k))
    at = {g: i for i, g in enumerate(keys)}
    for g, cell, v in zip(got["g_"], got["cell"], got["v"]):
        i, j = upper[cell]
        full[at[g], i, j] = full[at[g], j, i] = v
    return Moments(keys, full[:, 0, 0], full[:, :-1, :-1], full[:, :-1, -1], full[:, -1, -1], ["Intercept", *terms])


@dataclass
class Fit:
    """Coefficients with standard errors and two-sided p values; ``note`` is 'not estimable' if there are none."""

    terms: list[str]
    estimate: list[float | None]
    std_error: list[float | None]
    p_value: list[float | None]
    n: int
    note: str = ""
    extra: dict = field(default_factory=dict)

    def rows(self, model: str) -> list[tuple]:
        return [(model, t, e, s, p, *interval(e, s), self.n, self.note) for t, e, s, p in zip(self.terms, self.estimate, self.std_error, self.p_value)]


SCHEMA = "model string, term string, estimate double, std_error double, p_value double, low double, high double, n bigint, note string"


def interval(estimate: float | None, std_error: float | None, z: float = 1.96) -> tuple[float | None, float | None]:
    """Bounds of the normal interval; null without an error."""
    if estimate is None or std_error is None:
        return None, None
    return estimate - z * std_error, estimate + z * std_error


def _none(m: Moments) -> Fit:
    k = len(m.terms)
    return Fit(m.terms, [None] * k, [None] * k, [None] * k, int(m.n.sum()), "not estimable")


def _normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def cluster_ols(m: Moments) -> Fit:
    """Least squares with cluster-robust errors and the usual small-sample factor."""
    a, b = m.xtx.sum(0), m.xty.sum(0)
    n, k, g = m.n.sum(), len(m.terms), len(m.keys)
    if g < 2 or n <= k or np.linalg.matrix_rank(a) < k:
        return _none(m)
    inv = np.linalg.inv(a)
    beta = inv @ b
    scores = m.xty - m.xtx @ beta
    meat = scores.T @ scores
    v = inv @ meat @ inv * (g / (g - 1)) * ((n - 1) / (n - k))
    se = np.sqrt(np.maximum(np.diag(v), 0))
    return Fit(m.terms, beta.tolist(), se.tolist(), [_normal_p(x / s) if s > 0 else None for x, s in zip(beta, se)], int(n), "few clusters" if g < 30 else "")


def mixed(m: Moments) -> Fit:
    """Random-intercept model by restricted likelihood, profiled over the variance ratio."""
    n, k, g = m.n.sum(), len(m.terms), len(m.keys)
    if g < 2 or n <= k + 1 or np.linalg.matrix_rank(m.xtx.sum(0)) < k:
        return _none(m)
    sx = m.xtx[:, 0, :]  # sums of the columns: the intercept's row
    sy = m.xty[:, 0]

    def at(theta: float):
        w = theta / (1 + theta * m.n)
        a = m.xtx.sum(0) - np.einsum("g,gi,gj->ij", w, sx, sx)
        b = m.xty.sum(0) - (w * sy) @ sx
        c = m.yty.sum() - (w * sy * sy).sum()
        beta = np.linalg.solve(a, b)
        rss = c - beta @ b
        dev = (n - k) * math.log(max(rss, 1e-300)) + np.log1p(theta * m.n).sum() + np.linalg.slogdet(a)[1]
        return dev, beta, a, rss / (n - k)

    lo, hi = -12.0, 12.0
    grid = np.linspace(lo, hi, 49)
    i = int(np.argmin([at(math.exp(t))[0] for t in grid]))
    a_, b_ = grid[max(0, i - 1)], grid[min(48, i + 1)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c_, d_ = b_ - ratio * (b_ - a_), a_ + ratio * (b_ - a_)
        if at(math.exp(c_))[0] < at(math.exp(d_))[0]:
            b_ = d_
        else:
            a_ = c_
    theta = math.exp((a_ + b_) / 2)
    _, beta, a, s2 = at(theta)
    v = np.linalg.inv(a) * s2
    if s2 <= 0 or not np.all(np.isfinite(v)) or np.any(np.diag(v) <= 0):
        return _none(m)
    se = np.sqrt(np.diag(v))
    return Fit(m.terms, beta.tolist(), se.tolist(), [_normal_p(x / s) for x, s in zip(beta, se)], int(n), "", {"residual_variance": float(s2), "group_variance": float(s2 * theta)})


def weighted_trend(df: DataFrame, y: str, columns: list[str], weight: str) -> tuple[list[float] | None, int]:
    """Coefficients (intercept first) of a weighted regression over a small table, and its rows; None if singular."""
    rows = df.dropna(subset=[y, *columns, weight]).select(y, *columns, weight).toPandas()
    x = np.column_stack([np.ones(len(rows)), *[rows[c].to_numpy(float) for c in columns]])
    w, t = rows[weight].to_numpy(float), rows[y].to_numpy(float)
    a = x.T @ (x * w[:, None])
    if len(rows) < x.shape[1] or np.linalg.matrix_rank(a) < x.shape[1]:
        return None, len(rows)
    return np.linalg.solve(a, x.T @ (w * t)).tolist(), len(rows)


def weighted_fit(df: DataFrame, y: str, columns: list[str], weight: str) -> list[tuple[str, float, float, float]]:
    """(term, estimate, error, t) of a weighted regression over a small table; empty if singular or without degrees of freedom."""
    rows = df.dropna(subset=[y, *columns, weight]).select(y, *columns, weight).toPandas()
    x = np.column_stack([np.ones(len(rows)), *[rows[c].to_numpy(float) for c in columns]])
    w, t = rows[weight].to_numpy(float), rows[y].to_numpy(float)
    a = x.T @ (x * w[:, None])
    free = len(rows) - x.shape[1]
    if free < 1 or np.linalg.matrix_rank(a) < x.shape[1]:
        return []
    inv = np.linalg.inv(a)
    beta = inv @ (x.T @ (w * t))
    s2 = float((w * (t - x @ beta) ** 2).sum() / free)
    error = np.sqrt(np.diag(inv) * s2)
    return [(c, float(b), float(e), float(b / e) if e > 0 else 0.0) for c, b, e in zip(["Intercept", *columns], beta, error)]


def student_p(t: float, free: int) -> float:
    """Two-sided p of a t value, by the continued fraction of the incomplete beta function."""
    a, b, x = free / 2, 0.5, free / (free + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    value = front * h / a
    return 1 - value if flip else value


def drop_sparse(df: DataFrame, terms: list[str], least: int = 25) -> list[str]:
    """Terms with at least ``least`` positive rows; one aggregate."""
    got = df.agg(*[F.sum(F.when(F.col(t) > 0, 1).otherwise(0)).alias(t) for t in terms]).first()
    return [t for t in terms if (got[t] or 0) >= least]


def ordered_logit(counts: list[tuple[tuple, int, int]], levels: int, steps: int = 60) -> dict | None:
    """Proportional odds model over (x, level, count) cells by Newton steps; None if it does not converge."""
    if not counts:
        return None
    x = np.array([c[0] for c in counts], dtype=float)
    y = np.array([c[1] for c in counts])
    w = np.array([c[2] for c in counts], dtype=float)
    k, q = x.shape[1], levels - 1
    share = np.array([w[y <= j].sum() for j in range(q)]) / w.sum()
    p = np.concatenate([np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4))), np.zeros(k)])

    def loss(v):
        cuts = np.concatenate([[-40], v[:q], [40]])
        eta = x @ v[q:]
        up, down = 1 / (1 + np.exp(-(cuts[y + 1] - eta))), 1 / (1 + np.exp(-(cuts[y] - eta)))
        return -(w * np.log(np.maximum(up - down, 1e-12))).sum()

    def grad(v):
        e = 1e-5
        return np.array([(loss(v + e * d) - loss(v - e * d)) / (2 * e) for d in np.eye(len(v))])

    for _ in range(steps):
        g = grad(p)
        h = np.array([(grad(p + 1e-4 * d) - g) / 1e-4 for d in np.eye(len(p))])
        h = (h + h.T) / 2 + 1e-6 * np.eye(len(p))
        try:
            step = np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            return None
        size = 1.0
        while loss(p - size * step) > loss(p) and size > 1e-4:
            size /= 2
        p = p - size * step
        if np.abs(size * step).max() < 1e-6:
            try:
                se = np.sqrt(np.diag(np.linalg.inv(h)))
            except np.linalg.LinAlgError:
                return None
            return {"cuts": p[:q].tolist(), "coef": p[q:].tolist(), "std_error": se[q:].tolist(), "n": int(w.sum())}
    return None
