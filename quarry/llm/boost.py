"""Histogram gradient-boosted trees for a 0/1 label, kept as flat arrays and walked with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """All trees in one set of arrays: node k tests feature[k] <= threshold[k] and goes to left[k] or right[k]; a leaf points at itself and has a value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                below = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(below, self.left[at], self.right[at])
            out += self.value[at]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def constant(probability: float) -> Forest:
    """The forest for no rows or a single class: one leaf."""
    p = min(max(probability, 1e-3), 1 - 1e-3)
    zero = np.zeros(1, np.int32)
    return Forest(zero, np.zeros(1), zero, zero, np.zeros(1), zero, 0, float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, least: int = 5, l2: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss on at most 64 quantile bins a feature; depth-first trees of bounded depth. Deterministic."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return constant(y.mean() if len(y) else 0.5)
    at = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS))) for f in range(x.shape[1])]
    edges = [(u[1:] + u[:-1]) / 2 for u in at]  # half-way: a value just over one that was seen isn't yet on the far side
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    prior = y.mean()
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(0.0)
        return k

    def grow(k: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value[k] = -rate * total_g / (total_h + l2)
        if level == depth or len(rows) < 2 * least:
            margin[rows] += value[k]
            return
        best = (1e-6, -1, -1)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            size = len(e) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
            gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at)
        if best[1] < 0:
            margin[rows] += value[k]
            return
        _, f, at = best
        value[k] = 0.0
        feature[k], threshold[k] = f, float(edges[f][at])
        below = binned[rows, f] <= at
        left[k], right[k] = node(), node()
        grow(left[k], rows[below], g, h, level + 1)
        grow(right[k], rows[~below], g, h, level + 1)

    everything = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(node())
        grow(roots[-1], everything, p - y, np.maximum(p * (1 - p), 1e-6), 0)
    return Forest(*(np.array(v, t) for v, t in ((feature, np.int32), (threshold, np.float64), (left, np.int32), (right, np.int32), (value, np.float64), (roots, np.int32))), depth, base)
