"""Histogram gradient-boosted trees for a 0/1 label, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    smooth: float = 1.0
    least_weight: float = 1.0


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: node ``i`` has the children ``2i + 1`` and ``2i + 2``.

    ``feature`` and ``threshold`` have a row per tree and a column per inner node;
    ``leaf`` a column per leaf. A node that does not split sends all rows left.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all rows go down a tree level at a time."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return float(np.log(p / (1 - p)))


def fit(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Forest:
    """Boost on the logistic loss. Without rows of both labels the forest is a constant."""
    inner, leaves = (1 << settings.depth) - 1, 1 << settings.depth
    base = _log_odds(float(y.mean()) if len(y) else 0.5)
    if not len(y) or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    shares = np.linspace(0, 1, settings.bins + 1)[1:-1]
    cuts = [np.unique(np.quantile(column, shares)) for column in x.T]
    binned = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T)], axis=1)  # a bin holds values up to its cut
    width = settings.bins
    flat = binned + np.arange(x.shape[1]) * width
    out = Forest(base, np.zeros((settings.trees, inner), int), np.full((settings.trees, inner), np.inf), np.zeros((settings.trees, leaves)))
    score = np.full(len(y), base)
    rows = np.arange(len(y))
    for t in range(settings.trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(settings.depth):
            start, count = (1 << level) - 1, 1 << level
            cells = ((node - start)[:, None] * (width * x.shape[1]) + flat).ravel()
            shape = (count, x.shape[1], width)
            sums = [np.bincount(cells, np.repeat(v, x.shape[1]), count * x.shape[1] * width).reshape(shape) for v in (slope, bend)]
            left = [s.cumsum(axis=2) for s in sums]
            whole = [s[:, :, -1:] for s in left]
            right = [w - s for w, s in zip(whole, left)]
            gain = sum(g * g / (h + settings.smooth) for g, h in zip(*[(left[0], right[0]), (left[1], right[1])]))
            gain = gain - whole[0] ** 2 / (whole[1] + settings.smooth)
            gain[(left[1] < settings.least_weight) | (right[1] < settings.least_weight)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            go = np.full(count, width)  # bins up to this one go left
            feature = np.zeros(count, dtype=np.int64)
            for i, at in enumerate(best.tolist()):
                f, b = divmod(at, width)
                if gain[i, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[i], go[i] = f, b
                    out.feature[t, start + i], out.threshold[t, start + i] = f, cuts[f][b]
            here = node - start
            node = 2 * node + 1 + (binned[rows, feature[here]] > go[here])
        leaf = node - inner
        slopes, bends = (np.bincount(leaf, v, leaves) for v in (slope, bend))
        out.leaf[t] = settings.rate * slopes / (bends + settings.smooth)
        score += out.leaf[t][leaf]
    return out
