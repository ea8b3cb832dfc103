"""A small gradient-boosted tree classifier (logistic loss, binned features) in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of a fixed depth over binned features; everything is an array, so the fitted model travels as a small closure.

    A feature of at most ``bins`` distinct values has an edge between any two neighbouring ones, so
    that a rare indicator is seen; of others, half of the edges are quantiles of the rows and half
    quantiles of the distinct values. A leaf has ``least_rows`` rows at least.
    """

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16, least_weight: float = 0.05, least_rows: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.least_weight, self.least_rows = trees, depth, rate, bins, least_weight, least_rows

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [self._edges(column) for column in x.T]
        binned = self._bin(x)
        mean = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(mean / (1 - mean)))
        score, self.forest = np.full(len(y), self.base), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.forest.append(tree)
            score += self._leaf_values(tree, binned)
        return self

    def _edges(self, column: np.ndarray) -> np.ndarray:
        values = np.unique(column)
        if len(values) <= self.bins:
            return (values[1:] + values[:-1]) / 2
        half = self.bins // 2
        return np.unique(np.append(np.quantile(column, np.linspace(0, 1, half + 2)[1:-1]), np.quantile(values, np.linspace(0, 1, self.bins - half + 1)[1:-1])))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, column, "right") for e, column in zip(self.edges, x.T)], axis=1)

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and bin of each split in heap order, and the value of each leaf."""
        splits = (1 << self.depth) - 1
        feature, limit = np.zeros(splits, np.int64), np.full(splits, self.bins, np.int64)
        node = np.zeros(len(gradient), np.int64)
        for level in range(self.depth):
            first = (1 << level) - 1
            best = np.full(1 << level, 1e-9)
            for f in range(binned.shape[1]):
                cell = (node - first) * self.bins + binned[:, f]
                shape = (1 << level, self.bins)
                g = np.bincount(cell, gradient, shape[0] * shape[1]).reshape(shape).cumsum(axis=1)
                h = np.bincount(cell, weight, shape[0] * shape[1]).reshape(shape).cumsum(axis=1)
                n = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape).cumsum(axis=1)
                gt, ht, nt = g[:, -1:], h[:, -1:], n[:, -1:]
                gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                gain[(h < self.least_weight) | (ht - h < self.least_weight) | (n < self.least_rows) | (nt - n < self.least_rows)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(len(at)), at]
                better = np.flatnonzero(top > best)
                best[better], feature[first + better], limit[first + better] = top[better], f, at[better]
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > limit[node])
        leaf = node - splits
        g, h = np.bincount(leaf, gradient, splits + 1), np.bincount(leaf, weight, splits + 1)
        return feature, limit, -self.rate * g / (h + 1)

    def _leaf_values(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], binned: np.ndarray) -> np.ndarray:
        feature, limit, value = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > limit[node])
        return value[node - len(feature)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return 1 / (1 + np.exp(-(self.base + sum(self._leaf_values(t, binned) for t in self.forest))))
