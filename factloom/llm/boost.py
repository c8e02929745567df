"""Gradient-boosted trees of depth two for binary labels, over quantile bins."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, rounds: int = 60, rate: float = 0.3, bins: int = 16, penalty: float = 1.0):
        self.rounds, self.rate, self.bins, self.penalty = rounds, rate, bins, penalty
        self.base, self.trees = 0.0, []

    def _split(self, x, g, h, rows):
        """(gain, feature, threshold) of the best split of ``rows``."""
        best = (0.0, 0, np.inf)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + self.penalty)
        for f, cuts in enumerate(self.cuts):
            for c in cuts:
                left = x[rows, f] <= c
                if not left.any() or left.all():
                    continue
                gl, hl, gr, hr = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
                gain = gl**2 / (hl + self.penalty) + gr**2 / (hr + self.penalty) - whole
                if gain > best[0]:
                    best = (gain, f, c)
        return best

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            _, f, c = self._split(x, g, h, np.arange(len(y)))
            tree = [(f, c)]
            for side in (x[:, f] <= c, x[:, f] > c):
                rows = np.flatnonzero(side)
                _, f2, c2 = self._split(x, g, h, rows) if len(rows) else (0.0, 0, np.inf)
                leaf = [g[r].sum() / (h[r].sum() + self.penalty) if len(r := rows[m]) else 0.0 for m in (x[rows, f2] <= c2, x[rows, f2] > c2)]
                tree.append((f2, c2, leaf[0] * self.rate, leaf[1] * self.rate))
            self.trees.append(tree)
            score = score + self._tree(tree, x)
        return self

    @staticmethod
    def _tree(tree, x):
        (f, c), (f1, c1, a, b), (f2, c2, d, e) = tree
        return np.where(x[:, f] <= c, np.where(x[:, f1] <= c1, a, b), np.where(x[:, f2] <= c2, d, e))

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score = score + self._tree(tree, x)
        return 1 / (1 + np.exp(-score))
