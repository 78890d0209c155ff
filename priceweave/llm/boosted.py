"""Small gradient-boosted trees for two classes, over quantile bins, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of one depth as full binary trees: node i has the children 2i+1 and 2i+2."""

    def __init__(self, base: float, depth: int, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, rate: float):
        self.base, self.depth, self.feature, self.cut, self.leaf, self.rate = base, depth, feature, cut, leaf, rate

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += self.rate * leaf[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 2.0, clip: float = 4.0) -> BoostedTrees:
    """Newton boosting of the logistic loss; no randomness, so equal rows give an equal model."""
    n, width = x.shape if len(x) else (0, x.shape[1])
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    inner = 2**depth - 1
    features, cuts, leaves = [], [], []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                best = np.zeros(count)
                at_bin = np.full(count, bins, np.int64)
                for j in range(width):
                    key = (node - first) * bins + binned[:, j]
                    g = np.bincount(key, grad, count * bins).reshape(count, bins).cumsum(1)
                    h = np.bincount(key, hess, count * bins).reshape(count, bins).cumsum(1)
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                    gain = gain[:, : len(edges[j])]
                    if not gain.size:
                        continue
                    k = gain.argmax(1)
                    value = gain[np.arange(count), k]
                    better = value > best + 1e-9
                    best[better], at_bin[better] = value[better], k[better]
                    feature[first : first + count][better] = j
                    cut[first : first + count][better] = edges[j][k[better]]
                split = at_bin[node - first]
                right = np.where(split < bins, binned[np.arange(n), feature[node]] > split, False)
                node = 2 * node + 1 + right
            at = node - inner
            g, h = np.bincount(at, grad, inner + 1), np.bincount(at, hess, inner + 1)
            leaf = np.clip(g / (h + ridge), -clip, clip)
            score = score + rate * leaf[at]
            features.append(feature)
            cuts.append(cut)
            leaves.append(leaf)
    empty = np.zeros((0, inner))
    return BoostedTrees(base, depth, np.array(features, np.int64) if features else empty.astype(np.int64), np.array(cuts) if cuts else empty, np.array(leaves) if leaves else np.zeros((0, inner + 1)), rate)
