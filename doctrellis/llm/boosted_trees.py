"""Histogram gradient-boosted trees in numpy.

Features are cut into at most ``BINS`` bins at quantiles of the training rows.  Trees are
complete, of fixed depth, grown level by level from histograms of gradients and Hessians of
the log loss.  A fitted model is three flat arrays (split feature, threshold, leaf value), so
a batch of rows goes down all levels of a tree with a few vector operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Model:
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right if value > threshold; infinite where a node isn't split
    leaf: np.ndarray  # trees x leaves

    def raw(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        depth = self.leaf.shape[1].bit_length() - 1
        every = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            total += leaf[node - (2 ** depth - 1)]
        return total

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def constant(rate: float, n_features: int = 1) -> Model:
    odds = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    return Model(float(odds), np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, smoothing: float = 1.0, least: float = 3.0) -> Model:
    """Newton boosting; without both labels the model is constant (0.5 without rows)."""
    n, width = rows.shape
    mean = float(labels.mean()) if n else 0.5
    if n == 0 or mean in (0.0, 1.0):
        return constant(mean)
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = bins + np.arange(width) * BINS
    inner, leaves = 2 ** depth - 1, 2 ** depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    base = float(np.log(mean / (1 - mean)))
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, curvature = p - labels, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            place = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            size = count * width * BINS
            g, h = (np.bincount(place, weights=np.repeat(x, width), minlength=size).reshape(count, width, BINS) for x in (gradient, curvature))
            left_g, left_h = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
            all_g, all_h = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g ** 2 / (left_h + smoothing) + right_g ** 2 / (right_h + smoothing) - all_g ** 2 / (all_h + smoothing)
            gain[(left_h < least) | (right_h < least)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for k, at in enumerate(best):
                j, cut = divmod(int(at), BINS - 1)
                if gain[k, j, cut] > 1e-9 and cut < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][cut]
            node = 2 * node + 1 + (rows[np.arange(n), feature[t, node]] > threshold[t, node])
        node -= inner
        g, h = (np.bincount(node, weights=x, minlength=leaves) for x in (gradient, curvature))
        leaf[t] = -rate * g / (h + smoothing)
        score += leaf[t][node]
    return Model(base, feature, threshold, leaf)
