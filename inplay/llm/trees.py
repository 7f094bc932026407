"""Gradient-boosted trees and isotonic calibration of a bounded table of dense features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of one depth on binned features, fitted to log loss by second-order steps. A tree is three arrays laid out
    as a complete binary tree: feature and threshold of inner nodes, value of leaves; a node that is not worth a
    split sends all rows left."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least_weight: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least_weight = trees, depth, rate, bins, ridge, least_weight
        self.base = 0.0
        self.feature, self.threshold, self.leaf = [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], 1)
        logit = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-logit))
            feature, threshold, leaf, node = self._tree(binned, edges, p - y, p * (1 - p))
            self.feature.append(feature)
            self.threshold.append(threshold)
            self.leaf.append(leaf * self.rate)
            logit += leaf[node] * self.rate
        return self

    def _tree(self, binned: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, weight: np.ndarray):
        inner = 2**self.depth - 1
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node, start = np.zeros(len(slope), np.int64), 0  # node: place within the level
        for level in range(self.depth):
            many = 2**level
            best, cut = np.full(many, 1e-6), np.full(many, self.bins)
            for f in range(binned.shape[1]):
                cell = node * self.bins + binned[:, f]
                g = np.bincount(cell, slope, many * self.bins).reshape(many, self.bins).cumsum(1)
                h = np.bincount(cell, weight, many * self.bins).reshape(many, self.bins).cumsum(1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g * g / (h + self.ridge) + rest_g * rest_g / (rest_h + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                gain[(h < self.least_weight) | (rest_h < self.least_weight)] = 0
                gain[:, len(edges[f]):] = 0
                at = gain.argmax(1)
                better = gain[np.arange(many), at] > best
                best[better], cut[better] = gain[np.arange(many), at][better], at[better]
                feature[start:start + many][better] = f
                threshold[start:start + many][better] = edges[f][at[better]] if len(edges[f]) else np.inf
            node = 2 * node + (binned[np.arange(len(node)), feature[start + node]] > cut[node])
            start += many
        g, h = np.bincount(node, slope, inner + 1), np.bincount(node, weight, inner + 1)
        return feature, threshold, -g / (h + self.ridge), node

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step curve nearest to the labels in squares, by pooling neighbours that fall: (mean score, share) of
    each pool. Each pool's share leans towards one half by one row, so that no score is 0 or 1."""
    if not len(score):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    spot, first, tied = np.unique(score[order], return_index=True, return_counts=True)
    pools: list[list[float]] = []  # rows, sum of scores, sum of labels
    for x, n, s in zip(spot, tied, np.add.reduceat(label[order].astype(float), first)):
        pools.append([n, n * x, s])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    n, x, s = np.array(pools).T
    return x / n, np.maximum.accumulate((s + 0.5) / (n + 1))
