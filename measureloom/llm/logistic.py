"""Logistic regression on sparse binary features, for training sets of a stated bound."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of feature indices, with a few dense columns after them."""

    def __init__(self, rows: list, width: int, dense: np.ndarray | None = None):
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.index = np.concatenate([np.zeros(0, np.int64), *[np.asarray(r, np.int64) for r in rows]])
        self.row = np.repeat(np.arange(len(rows)), self.lengths)
        self.width, self.n = width, len(rows)
        self.dense = np.zeros((self.n, 0)) if dense is None else dense

    def dot(self, w: np.ndarray) -> np.ndarray:
        """w: feature weights, dense weights, intercept."""
        out = np.bincount(self.row, weights=w[self.index], minlength=self.n) if len(self.index) else np.zeros(self.n)
        return out + self.dense @ w[self.width:-1] + w[-1]

    def tdot(self, v: np.ndarray) -> np.ndarray:
        head = np.bincount(self.index, weights=v[self.row], minlength=self.width) if len(self.index) else np.zeros(self.width)
        return np.concatenate([head, self.dense.T @ v, [v.sum()]])

    def take(self, mask: np.ndarray) -> Sparse:
        at = np.flatnonzero(mask)
        ends = np.cumsum(self.lengths)
        return Sparse([self.index[ends[i] - self.lengths[i]:ends[i]] for i in at], self.width, self.dense[at])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(x: Sparse, y: np.ndarray, ridge: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Weights by Newton steps whose systems are solved by conjugate gradients; the intercept is free."""
    size = x.width + x.dense.shape[1] + 1
    w = np.zeros(size)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    w[-1] = np.log(share / (1 - share))
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x.dot(w))
        gradient = x.tdot(p - y) + penalty * w
        if np.abs(gradient).max() < 1e-5 * max(1, len(y)):
            break
        curve = np.maximum(p * (1 - p), 1e-9)
        step = _solve(lambda v, c=curve: x.tdot(c * x.dot(v)) + penalty * v, -gradient)
        w = w + step
    return w


def _solve(apply, b: np.ndarray, steps: int = 40) -> np.ndarray:
    x, r = np.zeros_like(b), b.copy()
    d, old = r.copy(), r @ r
    for _ in range(steps):
        if old < 1e-12:
            break
        q = apply(d)
        a = old / (d @ q)
        x, r = x + a * d, r - a * q
        new = r @ r
        d, old = r + new / old * d, new
    return x
