"""Gradient-boosted trees for two classes over binned features, small enough to fit a bounded sample in one process."""

from __future__ import annotations

import numpy as np


class Boosted:
    """``trees`` trees of a fixed depth; each is a heap of (feature, bin) tests with values at its leaves."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [self._edges(x[:, f]) for f in range(x.shape[1])]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.forest.append(tree)
            score += self._leaf(tree, binned)
        return self

    def _edges(self, values: np.ndarray) -> np.ndarray:
        """Quantiles, or what lies between the values if they are few, so that rare ones are told apart."""
        own = np.unique(values)
        if len(own) <= self.bins:
            return (own[1:] + own[:-1]) / 2
        return np.unique(np.quantile(values, np.linspace(0, 1, self.bins + 1)[1:-1]))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1).astype(np.int64)

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64)
        node = np.zeros(len(grad), np.int64)
        for level in range(self.depth):
            base, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            for f in range(binned.shape[1]):
                slot = (node - base) * self.bins + binned[:, f]
                g = np.bincount(slot, grad, width * self.bins).reshape(width, -1).cumsum(1)
                h = np.bincount(slot, hess, width * self.bins).reshape(width, -1).cumsum(1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                gain[(h < self.least) | (all_h - h < self.least)] = 0
                at = gain.argmax(1)
                value = gain[np.arange(width), at]
                better = value > best + 1e-9
                best[better] = value[better]
                feature[base : base + width][better] = f
                cut[base : base + width][better] = at[better]
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > cut[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        return feature, cut, -self.rate * g / (h + 1)

    def _leaf(self, tree, binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        binned = self._binned(x)
        return 1 / (1 + np.exp(-(self.start + sum(self._leaf(t, binned) for t in self.forest))))
