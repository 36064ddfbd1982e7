"""Histogram gradient-boosted trees for a yes/no label, kept as flat arrays and read by numpy for many rows at once."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete binary trees of one depth: ``feature`` and ``bin`` of each inner node, ``value`` of each leaf."""

    def __init__(self, edges: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, value: np.ndarray, base: float):
        self.edges, self.feature, self.cut, self.value, self.base = edges, feature, cut, value, base

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        binned, total = self.bins(x), np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Trees for the rows of ``x`` with labels ``y`` (0 or 1). Without rows, every prediction is one half.

    Each level adds up gradients and curvatures of all its nodes, features and bins at once and takes each node's best
    cut; a node without a useful one sends all its rows to the left.
    """
    n, features = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(features)]
    mean = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    inner, base = 2**depth - 1, float(np.log(mean / (1 - mean)))
    model = Trees(edges, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1)), base)
    if n == 0:
        return model
    binned, score = model.bins(x).astype(np.int64), np.full(n, base)
    all_features, all_cuts, all_values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, bins, np.int64), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * features + np.arange(features)) * bins + binned
            size = width * features * bins
            gs = np.bincount(key.ravel(), np.repeat(g, features), size).reshape(width, features, bins).cumsum(axis=2)
            hs = np.bincount(key.ravel(), np.repeat(h, features), size).reshape(width, features, bins).cumsum(axis=2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
            gain[(hs < least) | (h_all - hs < least)] = 0
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            useful = flat[np.arange(width), best] > 1e-9
            feature[first : first + width] = np.where(useful, best // bins, 0)
            cut[first : first + width] = np.where(useful, best % bins, bins)
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += value[leaf]
        all_features.append(feature), all_cuts.append(cut), all_values.append(value)
    return Trees(edges, np.array(all_features), np.array(all_cuts), np.array(all_values), base)
