"""Gradient-boosted regression trees for a yes/no label, on binned features."""

from __future__ import annotations

import numpy as np

BINS = 24


class BoostedTrees:
    """Fitted on a bounded table that the caller hands in; decision_function gives log odds."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.25, least: int = 10, ridge: float = 1.0, columns: float = 0.25, seed: int = 5) -> None:
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        #: Share of the features that a tree may use, and the seed of their choice.
        self.columns, self.seed = columns, seed
        #: Of each tree: feature and threshold of its inner nodes in heap order, and the values of its leaves.
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        steps = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if len(np.unique(c)) > 2 else np.unique(c)[:1] for c in x.T]
        binned = np.stack([np.searchsorted(s, c, "left") for s, c in zip(steps, x.T, strict=True)]).astype(np.int64)  # bin b: steps[b - 1] < value <= steps[b]
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        odds = np.full(len(y), self.start)
        width = BINS + 1
        rng = np.random.default_rng(self.seed)
        some = max(1, int(len(steps) * self.columns))
        shape, size = (some, width), some * width
        for _ in range(self.rounds):
            tried = np.sort(rng.choice(len(steps), some, replace=False))
            flat = binned[tried] + np.arange(some)[:, None] * width
            p = 1 / (1 + np.exp(-odds))
            grad, hess = y - p, p * (1 - p)
            inner = 2**self.depth - 1
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                if len(rows) >= 2 * self.least:
                    where = flat[:, rows].ravel()
                    g = np.bincount(where, np.tile(grad[rows], some), size).reshape(shape).cumsum(1)
                    h = np.bincount(where, np.tile(hess[rows], some), size).reshape(shape).cumsum(1)
                    c = np.bincount(where, minlength=size).reshape(shape).cumsum(1)
                    all_g, all_h = grad[rows].sum(), hess[rows].sum()
                    gain = g**2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge) - all_g**2 / (all_h + self.ridge)
                    gain[(c < self.least) | (len(rows) - c < self.least)] = -1
                    f, b = np.unravel_index(int(gain.argmax()), shape)
                    if gain[f, b] > 1e-6 and b < len(steps[tried[f]]):
                        feature[k], threshold[k] = tried[f], steps[tried[f]][b]
                right = x[rows, feature[k]] > threshold[k]
                node[rows] = 2 * k + 1 + right
            leaf = node - inner
            g = np.bincount(leaf, grad, inner + 1)
            h = np.bincount(leaf, hess, inner + 1)
            values = self.rate * g / (h + self.ridge)
            odds += values[leaf]
            self.trees.append((feature, threshold, values))
        return self

    def decision_function(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            odds += values[node - len(feature)]
        return odds
