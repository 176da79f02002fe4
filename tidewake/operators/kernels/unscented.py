"""Unscented filter over any motion and measurement function; a batch in the first axis."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def points(x: np.ndarray, p: np.ndarray, alpha: float = 1e-3, beta: float = 2.0, kappa: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sigma points (n, 2d + 1, d) with weights of mean and covariance."""
    d = x.shape[1]
    lam = alpha**2 * (d + kappa) - d
    root = np.linalg.cholesky((d + lam) * p + 1e-12 * np.eye(d)).transpose(0, 2, 1)
    sigma = np.concatenate([x[:, None], x[:, None] + root, x[:, None] - root], 1)
    mean = np.full(2 * d + 1, 0.5 / (d + lam))
    mean[0] = lam / (d + lam)
    cov = mean.copy()
    cov[0] += 1 - alpha**2 + beta
    return sigma, mean, cov


def predict(x: np.ndarray, p: np.ndarray, move: Callable, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sigma, wm, wc = points(x, p)
    moved = np.stack([move(sigma[:, k]) for k in range(sigma.shape[1])], 1)
    mean = np.einsum("k,nkd->nd", wm, moved)
    off = moved - mean[:, None]
    return mean, np.einsum("k,nki,nkj->nij", wc, off, off) + noise


def update(x: np.ndarray, p: np.ndarray, z: np.ndarray, measure: Callable, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sigma, wm, wc = points(x, p)
    seen = np.stack([measure(sigma[:, k]) for k in range(sigma.shape[1])], 1)
    mean = np.einsum("k,nkd->nd", wm, seen)
    off, dx = seen - mean[:, None], sigma - x[:, None]
    s = np.einsum("k,nki,nkj->nij", wc, off, off) + noise
    gain = np.linalg.solve(s, np.einsum("k,nki,nkj->nij", wc, off, dx)).transpose(0, 2, 1)
    return x + (gain @ (z - mean)[..., None])[..., 0], p - gain @ s @ gain.transpose(0, 2, 1)
