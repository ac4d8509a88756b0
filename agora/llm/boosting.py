"""Histogram gradient-boosted trees in numpy, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees side by side: node k of a tree has children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): right when the value is above
    leaf: np.ndarray  # (trees, leaves)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities, all rows going down one tree together."""
        margin = np.full(len(rows), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        every = np.arange(len(rows))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > cut[node])
            margin += leaf[node - len(cut)]
        return 1 / (1 + np.exp(-margin))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.15, smooth: float = 1.0, least: float = 1.0) -> Trees:
    """Second-order boosting of the log loss over quantile histograms.

    With one class only, or no rows, every score is that class's smoothed share.
    """
    n = len(labels)
    share = (labels.sum() + 1) / (n + 2) if n else 0.5
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature = np.zeros((trees, inner), dtype=np.int64)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if n == 0 or labels.min() == labels.max():
        return Trees(base, feature[:0], cut[:0], leaf[:0])
    width = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1)
    spread = codes + np.arange(width) * bins
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = labels - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            place = ((node - first)[:, None] * (width * bins) + spread).ravel()
            shape = (count, width, bins)
            g = np.bincount(place, np.repeat(grad, width), count * width * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(place, np.repeat(hess, width), count * width * bins).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + smooth) + (all_g - g) ** 2 / (all_h - h + smooth) - all_g**2 / (all_h + smooth)
            gain[(h < least) | (all_h - h < least)] = -np.inf
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], cut[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (rows[np.arange(n), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + smooth)
        margin += leaf[t, at]
    return Trees(base, feature, cut, leaf)
