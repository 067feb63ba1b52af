"""Gradient-boosted regression trees for a binary label, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth over binned features, fitted to the log loss."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 3.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        b, wide = self._binned(x), self.bins + 1
        share = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        self.features, self.cuts, self.values = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - y), weight * p * (1 - p)
            node, feature, cut = np.zeros(len(y), dtype=np.int64), [], []
            for level in range(self.depth):
                n = 1 << level
                best, pick = np.zeros(n), np.zeros((n, 2), dtype=np.int64)
                pick[:, 1] = wide  # no cut: all to the left
                for k in range(b.shape[1]):
                    place = node * wide + b[:, k]
                    gs = np.bincount(place, g, n * wide).reshape(n, wide)
                    hs = np.bincount(place, h, n * wide).reshape(n, wide)
                    gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < self.least) | (ht - hl < self.least)] = 0
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(n), top]
                    better = value > best + 1e-9
                    best[better] = value[better]
                    pick[better] = np.stack([np.full(n, k), top], axis=1)[better]
                feature.append(pick[:, 0])
                cut.append(pick[:, 1])
                node = 2 * node + (b[np.arange(len(y)), pick[node, 0]] > pick[node, 1])
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            score += value[node]
            self.features.append(np.concatenate(feature))
            self.cuts.append(np.concatenate(cut))
            self.values.append(value)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, value in zip(self.features, self.cuts, self.values):
            node, first = np.zeros(len(x), dtype=np.int64), 0
            for level in range(self.depth):
                at = first + node
                node = 2 * node + (b[rows, feature[at]] > cut[at])
                first += 1 << level
            score += value[node]
        return score
