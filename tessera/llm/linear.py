"""Logistic models in numpy, for fits on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method for logistic loss with an L2 penalty; no intercept of its own."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + l2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Sparse:
    """Rows of 0/1 features in compressed rows, with a few dense columns beside them."""

    def __init__(self, rows: list[np.ndarray], width: int, dense: np.ndarray):
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.width, self.dense = len(rows), width, dense

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n) + self.dense @ w[self.width :]

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(self.at, r[self.row], self.width), self.dense.T @ r]


def fit_sparse(x: Sparse, y: np.ndarray, keep: np.ndarray | None = None, l2: float = 0.05, steps: int = 150) -> np.ndarray:
    """Logistic loss with an L2 penalty by accelerated gradient steps; classes weigh alike. keep: rows to fit on."""
    weight = np.ones(x.n) if keep is None else keep.astype(float)
    for c in (0, 1):
        own = weight[y == c].sum()
        weight[y == c] *= 0.5 / max(own, 1)
    w = np.zeros(x.width + x.dense.shape[1])
    v, past = w.copy(), w
    norm = np.bincount(x.row, minlength=x.n).max(initial=1) + (x.dense**2).sum(1).max(initial=0)
    rate = 1 / (0.25 * min(norm, 64) + l2 * 0.01)
    for k in range(steps):
        g = x.t_dot(weight * (sigmoid(x.dot(v)) - y)) + l2 * 0.01 * v
        w, past = v - rate * g, w
        v = w + k / (k + 3) * (w - past)
    return w
