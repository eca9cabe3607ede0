"""Gradient-boosted trees and isotonic calibration in numpy, for bounded samples of dense features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Boosted:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - len(f)]
        return total


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: int = 8) -> Boosted:
    """Second-order boosting on logistic loss with histogram splits; no randomness."""
    n, width = x.shape
    edges = [np.zeros(0)] * width if not n else [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    edges = [np.unique(np.r_[0.0, e]) if len(c) and c.min() <= 0 < c.max() else e for e, c in zip(edges, x.T, strict=True)]
    coded = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)  # code > i is x > edge i
    most = max((len(e) for e in edges), default=0) + 1
    p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    score, inner = np.full(n, base), (1 << depth) - 1
    trees = ([], [], [])
    for _ in range(rounds if n else 0):
        prob = sigmoid(score)
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = node - first
            best = np.full(count, 1e-9)
            for j in range(width):
                key = at * most + coded[:, j]
                gs, hs, ns = (np.bincount(key, w, count * most).reshape(count, most).cumsum(axis=1) for w in (g, h, None))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(ns < least) | (nt - ns < least)] = 0
                gain = gain[:, : len(edges[j])]
                if gain.shape[1]:
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(count), k] > best
                    best[better] = gain[np.arange(count), k][better]
                    feature[first : first + count][better] = j
                    threshold[first : first + count][better] = edges[j][k[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        score += value[leaf]
        for to, what in zip(trees, (feature, threshold, value), strict=True):
            to.append(what)
    shape = lambda a, w: np.array(a).reshape(-1, w)
    return Boosted(depth, base, shape(trees[0], inner).astype(np.int64), shape(trees[1], inner), shape(trees[2], 1 << depth))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a non-decreasing map from raw scores to rates, by pooling adjacent violators; rates are drawn in a little from 0 and 1."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of raw
    for r, t in zip(raw[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.array([-1.0, 1.0]), np.array([0.25, 0.75])
    s, n, r = np.array(blocks).T
    return r / n, (s + 0.25) / (n + 0.5)


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rates between the knots by a straight line; a trace of the raw score keeps the order of rows on a flat part."""
    return np.clip(np.interp(raw, *knots) * 0.998 + 0.002 * sigmoid(raw), 0.0, 1.0)
