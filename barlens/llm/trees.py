"""Histogram gradient-boosted trees for a binary label, in numpy; a fitted model is a few flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth. feature and threshold: (trees, 2**depth - 1) by node, children of
    node i at 2i+1 and 2i+2; value: (trees, 2**depth) by leaf. A row goes right where its feature is over the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all rows take each step of a tree at once."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        depth = int(self.value.shape[1]).bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (len(value) - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, l2: float = 1.0, least_weight: float = 3.0) -> Forest:
    """Boosts on the logistic loss with second-order gains; splits lie between quantile bins.
    Without rows, or with a single class, the forest has no trees and gives the smoothed share of label 1."""
    n, k = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    nodes, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    at = binned + np.arange(k) * bins  # a cell of the histogram of one node
    total = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cells = ((node[:, None] - first) * (k * bins) + at).ravel()
            size = count * k * bins
            gh = np.bincount(cells, np.repeat(g, k), size).reshape(count, k, bins).cumsum(axis=2)
            hh = np.bincount(cells, np.repeat(h, k), size).reshape(count, k, bins).cumsum(axis=2)
            gt, ht = gh[:, :, -1:], hh[:, :, -1:]
            gain = gh**2 / (hh + l2) + (gt - gh) ** 2 / (ht - hh + l2) - gt**2 / (ht + l2)
            gain[(hh < least_weight) | (ht - hh < least_weight)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            which, where = np.divmod(best, bins)
            for i in range(count):
                if gain[i, which[i], where[i]] > 1e-9 and where[i] < len(cuts[which[i]]):
                    feature[first + i], threshold[first + i] = which[i], cuts[which[i]][where[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - nodes
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)
