"""Gradient-boosted trees for a binary label, in numpy: quantile bins, depth-limited trees, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 16
    penalty: float = 1.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    #: Per tree, arrays over its nodes in heap order: feature (-1 at a leaf), bin (go left if <=), value.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(b, y - prob, prob * (1 - prob))
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _grow(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray):  # noqa: ANN202
        size = 2 ** (self.depth + 1)
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        at = np.ones(len(b), int)
        for node in range(1, size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            g, h = grad[rows], hess[rows]
            value[node] = self.rate * g.sum() / (h.sum() + self.penalty)
            if node >= size // 2 or len(rows) < 10:
                continue
            whole, best = g.sum() ** 2 / (h.sum() + self.penalty), 1e-6
            for j in range(b.shape[1]):
                gl = np.bincount(b[rows, j], g, self.bins + 1).cumsum()[:-1]
                hl = np.bincount(b[rows, j], h, self.bins + 1).cumsum()[:-1]
                gain = gl**2 / (hl + self.penalty) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.penalty) - whole
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], j, k
            if feature[node] >= 0:
                at[rows] = 2 * node + (b[rows, feature[node]] > cut[node])
        return (feature, cut, value), at

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._bin(x)
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.ones(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + (b[rows, np.maximum(f, 0)] > cut[at]), at)
            score += value[at]
        return 1 / (1 + np.exp(-score))
