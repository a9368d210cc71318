"""Gradient-boosted trees over all classes at once, for models that are fitted
on a bounded sample: second-order softmax boosting with histograms of binned
features. Fitting is deterministic; a fitted model is a few arrays that score
any number of rows."""

from __future__ import annotations

import numpy as np

#: Stands for "no split": every row goes left.
_ALL = np.float32(np.inf)


class BoostedTrees:
    """``feature`` and ``limit`` hold the splits of complete trees, shape
    (rounds, classes, 2 ** depth - 1); ``leaf`` their margins."""

    def __init__(self, feature: np.ndarray, limit: np.ndarray, leaf: np.ndarray, start: np.ndarray):
        self.feature, self.limit, self.leaf, self.start = feature, limit, leaf, start

    def margins(self, x: np.ndarray) -> np.ndarray:
        rounds, classes, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        out = np.tile(self.start, (len(x), 1))
        flat, width = np.ascontiguousarray(x, np.float32).ravel(), x.shape[1]
        base = np.arange(len(x)) * width
        for r in range(rounds):
            for c in range(classes):
                feature, limit = self.feature[r, c], self.limit[r, c]
                node = np.zeros(len(x), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (flat[base + feature[node]] > limit[node])
                out[:, c] += self.leaf[r, c][node - inner]
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        return log_softmax(self.margins(x))


def log_softmax(margins: np.ndarray) -> np.ndarray:
    top = margins - margins.max(axis=1, keepdims=True)
    return top - np.log(np.exp(top).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.3,
        penalty: float = 1.0, bins: int = 16) -> BoostedTrees:
    """Trees of ``depth`` levels for each class and round, grown level by level
    on gradient and hessian histograms of at most ``bins`` cells a feature."""
    x = np.ascontiguousarray(x, np.float32)
    n, width = x.shape
    limits = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower")) for f in range(width)]
    cells = np.stack([np.searchsorted(limits[f], x[:, f], side="left") for f in range(width)], axis=1)
    offset = cells + np.arange(width) * bins
    prior = np.bincount(y, minlength=classes) + 1.0
    start = np.log(prior / prior.sum())
    margins = np.tile(start, (n, 1))
    target = np.eye(classes)[y]
    inner = 2 ** depth - 1
    feature = np.zeros((rounds, classes, inner), np.int64)
    limit = np.full((rounds, classes, inner), _ALL, np.float32)
    leaf = np.zeros((rounds, classes, 2 ** depth))
    for r in range(rounds):
        p = np.exp(log_softmax(margins))
        for c in range(classes):
            gradient, hessian = p[:, c] - target[:, c], p[:, c] * (1 - p[:, c])
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, many = 2 ** level - 1, 2 ** level
                at = ((node - first)[:, None] * (width * bins) + offset).ravel()
                g, h = (np.bincount(at, np.repeat(v, width), many * width * bins).reshape(many, width, bins)
                        for v in (gradient, hessian))
                left_g, left_h = g.cumsum(2)[..., :-1], h.cumsum(2)[..., :-1]
                all_g, all_h = g[:, :1].sum(2, keepdims=True), h[:, :1].sum(2, keepdims=True)
                gain = (left_g ** 2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty)
                        - all_g ** 2 / (all_h + penalty))
                gain[(left_h < 1e-3) | (all_h - left_h < 1e-3)] = 0
                best = gain.reshape(many, -1).argmax(1)
                worth = gain.reshape(many, -1).max(1) > 1e-6
                f, cell = best // (bins - 1), best % (bins - 1)
                for k in np.flatnonzero(worth).tolist():
                    feature[r, c, first + k] = f[k]
                    limit[r, c, first + k] = limits[f[k]][cell[k]] if cell[k] < len(limits[f[k]]) else _ALL
                node = 2 * node + 1 + (x[np.arange(n), feature[r, c][node]] > limit[r, c][node])
            place = node - inner
            leaf[r, c] = -rate * np.bincount(place, gradient, 2 ** depth) / (np.bincount(place, hessian, 2 ** depth) + penalty)
            margins[:, c] += leaf[r, c][place]
    return BoostedTrees(feature, limit, leaf, start)
