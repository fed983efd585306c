"""Small gradient-boosted trees for binary targets: logistic loss, exact splits over quantile bins."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of a fixed depth stored as arrays; fit on bounded in-memory data, cheap to pickle to executors."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.base = 0.0
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        raw = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            gradient, weight = y - p, p * (1 - p)
            feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
            at = np.zeros(len(y), np.int64)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                best = 1e-6
                split = None
                if len(rows) > 8:
                    g, h = gradient[rows], weight[rows]
                    total_g, total_h = g.sum(), h.sum()
                    parent = total_g**2 / (total_h + self.ridge)
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        left_g = np.cumsum(np.bincount(binned[rows, j], g, len(e) + 1))[:-1]
                        left_h = np.cumsum(np.bincount(binned[rows, j], h, len(e) + 1))[:-1]
                        gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - parent
                        k = int(np.argmax(gain))
                        if gain[k] > best:
                            best, split = gain[k], (j, e[k])
                if split is None:
                    at[rows] = 2 * node + 1
                    continue
                feature[node], cut[node] = split
                at[rows] = np.where(x[rows, split[0]] <= split[1], 2 * node + 1, 2 * node + 2)
            slot = at - inner
            sums, weights = np.bincount(slot, gradient, inner + 1), np.bincount(slot, weight, inner + 1)
            leaf = self.rate * sums / (weights + self.ridge)
            raw += leaf[slot]
            self.nodes.append((feature, cut, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients (the last is the constant) of a ridge logistic regression by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.ones(len(y)) if weight is None else weight
    b = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        gradient = a.T @ (w * (y - p)) - penalty @ b
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + penalty, gradient)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b
