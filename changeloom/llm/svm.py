"""Linear support vector machine with hinge loss, fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np


def fit_dual(indptr: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, dim: int, c: float = 1.0, epochs: int = 20, tol: float = 1e-3, balance: bool = True, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias for rows in CSR form and labels of -1 and 1.

    min 1/2 |w|^2 + sum C_i max(0, 1 - y_i w.x_i), solved one dual variable at a time (0 <= a_i <= C_i) in random
    order, with the bias as a constant feature. balance gives both classes the same total cost. Stops when the projected
    gradient's spread falls under tol. One class only, or no rows: weights 0 and the class as bias.
    """
    n = len(y)
    w, b = np.zeros(dim), 0.0
    if n == 0 or (y == y[0]).all():
        return w, float(y[0]) if n else 0.0
    cost = np.full(n, c)
    if balance:
        for s in (-1, 1):
            cost[y == s] *= n / (2 * (y == s).sum())
    norm = np.array([np.dot(value[i:j], value[i:j]) for i, j in zip(indptr[:-1], indptr[1:], strict=True)]) + 1.0
    alpha = np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            at = slice(indptr[i], indptr[i + 1])
            k, v = index[at], value[at]
            g = y[i] * (np.dot(w[k], v) + b) - 1
            a = alpha[i]
            pg = min(g, 0) if a <= 0 else max(g, 0) if a >= cost[i] else g
            if pg:
                worst = max(worst, abs(pg))
                alpha[i] = min(max(a - g / norm[i], 0.0), cost[i])
                d = (alpha[i] - a) * y[i]
                w[k] += d * v
                b += d
        if worst < tol:
            break
    return w, float(b)
