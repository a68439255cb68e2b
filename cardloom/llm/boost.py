"""Gradient-boosted trees for small tables of features, in numpy.

Logistic loss, depth-wise trees over every observed threshold, Newton leaf
values; probabilities are calibrated on held-out rows by a logistic curve.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, penalty: float = 1.0, least: int = 8):
        self.rounds, self.depth, self.rate, self.penalty, self.least = rounds, depth, rate, penalty, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.slope, self.shift = 0.0, 1.0, 0.0

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
        best = (1e-9, -1, 0.0)
        total_g, total_h = g.sum(), h.sum()
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= self.least) & (len(v) - at - 1 >= self.least)]
            if not len(at):
                continue
            gain = cg[at] ** 2 / (ch[at] + self.penalty) + (total_g - cg[at]) ** 2 / (total_h - ch[at] + self.penalty) - total_g**2 / (total_h + self.penalty)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(v[at[k]] + v[at[k] + 1]) / 2)
        return best

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete tree in heap order; a feature of -1 sends every row left."""
        n = (1 << self.depth) - 1
        feature, cut = np.full(n, -1), np.zeros(n)
        value = np.zeros(1 << self.depth)
        at = np.zeros(len(x), int)
        for node in range(n):
            rows = np.flatnonzero(at == node)
            if len(rows) >= 2 * self.least:
                _, feature[node], cut[node] = self._split(x[rows], g[rows], h[rows])
            right = x[rows, feature[node]] > cut[node] if feature[node] >= 0 else np.zeros(len(rows), bool)
            at[rows] = 2 * node + 1 + right
        for leaf in range(1 << self.depth):
            rows = at == n + leaf
            value[leaf] = -g[rows].sum() / (h[rows].sum() + self.penalty) * self.rate if rows.any() else 0.0
        return feature, cut, value

    def _tree(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), int)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            at = 2 * at + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[at]))
        return value[at - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self._tree(t, x)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(x, q - y, q * (1 - q))
            self.trees.append(tree)
            score += self._tree(tree, x)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """A logistic curve over raw scores, by Newton steps with a little ridge."""
        s = np.stack([self.raw(x), np.ones(len(x))], 1)
        w = np.array([1.0, 0.0])
        for _ in range(25):
            q = 1 / (1 + np.exp(-s @ w))
            grad = s.T @ (q - y) + 1e-2 * (w - [1.0, 0.0])
            w -= np.linalg.solve((s * (q * (1 - q))[:, None]).T @ s + 1e-2 * np.eye(2), grad)
        self.slope, self.shift = map(float, w)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))
