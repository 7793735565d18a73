"""Logistic regression by Newton's method, for samples of a bounded size."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, penalty: np.ndarray | None = None, steps: int = 30):
    """(coefficients, intercept). ``penalty``: a positive semidefinite matrix P for a term w'Pw / 2 beside the ridge."""
    n, k = x.shape
    weight = np.ones(n) if weight is None else weight
    a = np.hstack([x, np.ones((n, 1))]).astype(np.float64)
    prior = ridge * np.eye(k + 1)
    prior[k, k] = 1e-6
    if penalty is not None:
        prior[:k, :k] += penalty
    rate = float(np.clip((weight @ y) / weight.sum(), 1e-6, 1 - 1e-6))
    w = np.zeros(k + 1)
    w[k] = np.log(rate / (1 - rate))

    def loss(v):
        z = a @ v
        return weight @ (np.logaddexp(0, z) - y * z) + v @ prior @ v / 2

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(a @ w)
        grad = a.T @ (weight * (p - y)) + prior @ w
        hess = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + prior
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-9 * (1 + abs(now)):
            break
        w, now = w - size * step, then
    return w[:k], float(w[k])
