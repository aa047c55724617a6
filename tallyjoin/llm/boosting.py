"""A small gradient-boosted classifier: logistic loss, depth-limited trees on binned features, Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 16
    least: int = 8
    nodes: list[list[tuple]] = field(default_factory=list)
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-raw))
            tree: list[tuple] = []
            self._grow(tree, x, y - q, q * (1 - q), np.arange(len(y)), edges, self.depth)
            self.nodes.append(tree)
            raw += self._tree(tree, x)
        return self

    def _grow(self, tree, x, grad, hess, rows, edges, depth) -> int:
        """Appends the node of rows, then its children; returns its number."""
        at = len(tree)
        g, h = grad[rows].sum(), hess[rows].sum() + 1.0
        tree.append((-1, 0.0, 0, 0, self.rate * g / h))
        best = (1e-6, None)
        for f in range(x.shape[1]) if depth else ():
            for t in edges[f]:
                left = x[rows, f] <= t
                n = int(left.sum())
                if self.least <= n <= len(rows) - self.least:
                    gl, hl = grad[rows[left]].sum(), hess[rows[left]].sum() + 1.0
                    gain = gl * gl / hl + (g - gl) ** 2 / (h - hl + 1.0) - g * g / h
                    if gain > best[0]:
                        best = (gain, (f, float(t), left))
        if best[1]:
            f, t, left = best[1]
            a = self._grow(tree, x, grad, hess, rows[left], edges, depth - 1)
            b = self._grow(tree, x, grad, hess, rows[~left], edges, depth - 1)
            tree[at] = (f, t, a, b, 0.0)
        return at

    @staticmethod
    def _tree(tree, x) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        f, t, a, b, v = (np.array(c) for c in zip(*tree, strict=True))
        for _ in range(len(tree).bit_length() + 1):
            inner = f[at] >= 0
            go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
            at = np.where(inner, np.where(go, a[at], b[at]), at)
        return v[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._tree(t, x) for t in self.nodes), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on rows that weren't fitted, by Newton steps."""
        r, (a, b) = self.raw(x), (1.0, 0.0)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * r + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((target - p) * r).sum() - 1e-3 * a, (target - p).sum()])
            hess = np.array([[(w * r * r).sum() + 1e-3, (w * r).sum()], [(w * r).sum(), w.sum() + 1e-9]])
            step = np.linalg.solve(hess, grad)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.scale = (float(a), float(b))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30)))
