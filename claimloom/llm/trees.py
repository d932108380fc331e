"""Gradient-boosted trees for a binary label, in numpy.

Histogram splits on quantile bins with the second-order gain of the logistic
loss.  A feature may be held monotone: a split against its direction is not
taken, and each child's values are bounded by the middle of the two.  The
ensemble is flattened into node arrays that are scored a level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node arrays of all trees; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 4.0, ridge: float = 2.0) -> Forest:
    """``monotone``: for each feature 1 (rises with the label's odds), -1 (falls) or 0."""
    n, m = x.shape
    p = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, m), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)

    def leaf(v: float) -> int:
        k = len(value)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(rate * v)
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        G, H = g[rows].sum(), h[rows].sum()
        node = leaf(float(np.clip(-G / (H + ridge), low, high)))
        if level == depth or len(rows) < 2 * least:
            margin[rows] += value[node]
            return node
        best = (1e-3, -1, -1, 0.0, 0.0)
        for j in range(m):
            if not len(cuts[j]):
                continue
            k = len(cuts[j]) + 1
            gl = np.cumsum(np.bincount(code[rows, j], g[rows], k))[:-1]
            hl = np.cumsum(np.bincount(code[rows, j], h[rows], k))[:-1]
            nl = np.cumsum(np.bincount(code[rows, j], minlength=k))[:-1]
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(G - gl) / (H - hl + ridge), low, high)
            gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
            ok = (nl >= least) & (len(rows) - nl >= least) & ((vr - vl) * monotone[j] >= 0)
            gain = np.where(ok, gain, -1.0)
            b = int(np.argmax(gain))
            if gain[b] > best[0]:
                best = (float(gain[b]), j, b, float(vl[b]), float(vr[b]))
        _, j, b, vl, vr = best
        if j < 0:
            margin[rows] += value[node]
            return node
        middle = (vl + vr) / 2
        to_left = code[rows, j] <= b
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
        feature[node], threshold[node] = j, float(cuts[j][b])
        left[node] = grow(rows[to_left], g, h, level + 1, *bounds[0])
        right[node] = grow(rows[~to_left], g, h, level + 1, *bounds[1])
        return node

    for _ in range(trees if n else 0):
        q = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), q - y, q * (1 - q), 0, -np.inf, np.inf))
    return Forest(base, np.array(roots, dtype=np.int64), np.array(feature, dtype=np.int64), np.array(threshold), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(value), depth)
