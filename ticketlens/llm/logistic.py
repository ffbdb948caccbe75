"""Small logistic regressions on bounded samples, and their calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(z, np.float64)))


def fit_sparse(rows, ids, values, labels, width: int, penalty: float = 1e-4, steps: int = 150):
    """Weights and bias of a ridge logistic regression on coordinate triples.

    Accelerated gradient steps of a length that the largest row norm allows.
    """
    count = len(labels)
    y = np.asarray(labels, np.float64)
    norms = np.bincount(rows, values * values, minlength=count)
    step = 1.0 / (0.25 * (1.0 + (norms.max() if count else 1.0)) + penalty)
    w, b = np.zeros(width), 0.0
    share = np.clip(y.mean() if count else 0.5, 1e-3, 1 - 1e-3)
    b = float(np.log(share / (1 - share)))
    vw, vb = w.copy(), b
    for k in range(steps):
        gap = sigmoid(np.bincount(rows, values * vw[ids], minlength=count) + vb) - y
        gw = np.bincount(ids, values * gap[rows], minlength=width) / max(1, count) + penalty * vw
        nw, nb = vw - step * gw, vb - step * gap.mean() if count else vb
        pace = k / (k + 3.0)
        vw, vb = nw + pace * (nw - w), nb + pace * (nb - b)
        w, b = nw, nb
    return w, b


def fit_dense(x: np.ndarray, labels, prior: np.ndarray, penalty: float = 1.0, steps: int = 25):
    """Newton steps for a ridge regression that falls back to `prior` where data is thin."""
    y = np.asarray(labels, np.float64)
    w = prior.astype(np.float64).copy()
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w = w - np.clip(move, -2.0, 2.0)
        if np.abs(move).max() < 1e-8:
            break
    return w


def calibrate(z, labels) -> tuple[float, float]:
    """Slope and offset that turn raw scores into probabilities (Platt, on rows not fitted)."""
    z = np.asarray(z, np.float64)
    if not len(z):
        return 1.0, 0.0
    x = np.stack([z, np.ones(len(z))], axis=1)
    slope, offset = fit_dense(x, labels, np.array([1.0, 0.0]))
    return (float(slope), float(offset)) if slope > 0 else (1.0, 0.0)
