"""Small linear models, fitted on the driver on bounded samples."""

from __future__ import annotations

import numpy as np


Sparse = tuple[np.ndarray, np.ndarray]  # places and values of a row that are not zero


def svm(rows: list[Sparse], y: np.ndarray, dim: int, c: float = 10.0, epochs: int = 30, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, by dual coordinate descent. y: -1 or 1."""
    rows = [(np.r_[at, dim], np.r_[v, 1.0]) for at, v in rows]
    q = [v @ v + 0.5 / c for _, v in rows]
    alpha, w, order = [0.0] * len(rows), np.zeros(dim + 1), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            at, v = rows[i]
            new = max(0.0, alpha[i] - (y[i] * (w[at] @ v) - 1 + alpha[i] * 0.5 / c) / q[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, moves: np.ndarray, l2: float, fairness: float, steps: int = 800) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression that also pays fairness * (moves @ w) ** 2 on average.

    moves: feature changes under which the score should stay. Accelerated gradient descent.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    keep = np.ones(x.shape[1])
    keep[-1] = 0
    w = v = np.zeros(x.shape[1])
    row_norm = (x * x).sum(1)
    rate = 1 / (0.25 * row_norm.mean() + l2 + 2 * fairness * ((moves * moves).sum(1).mean() if len(moves) else 0))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -35, 35)))
        g = x.T @ (p - y) / len(y) + l2 * keep * v
        if len(moves):
            g[:-1] += 2 * fairness * (moves.T @ (moves @ v[:-1])) / len(moves)
        new = v - rate * g
        v = new + k / (k + 3) * (new - w)
        w = new
    return w
