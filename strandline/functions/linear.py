"""Small dense linear algebra of fits and machines: numpy only."""

from __future__ import annotations

import numpy as np


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """Covariance of the rows shrunk towards a scaled identity by the closed-form intensity."""
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    spread = ((s - mu * np.eye(p)) ** 2).sum() / p
    noise = (((x**2).T @ (x**2)) / n - s**2).sum() / (n * p)
    shrink = 0.0 if spread == 0 else min(noise, spread) / spread
    return shrink * mu * np.eye(p) + (1 - shrink) * s


def precision(x: np.ndarray, least: int = 10) -> np.ndarray:
    """Inverse of the shrunk covariance; the identity for fewer than ``least`` rows."""
    return np.linalg.pinv(ledoit_wolf(x)) if len(x) >= least else np.eye(x.shape[1])


def distances(x: np.ndarray, centre: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    d = np.atleast_2d(x) - centre
    return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inverse, d), 0.0))


def middle_and_scale(values, eps: float = 1e-9) -> tuple[float, float]:
    """Median, and the largest of 1.4826 MAD, IQR / 1.349 and ``eps``."""
    x = np.asarray(values, float)
    mid = float(np.median(x))
    return mid, max(1.4826 * float(np.median(np.abs(x - mid))), float(np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.349, eps)


def unit(v: np.ndarray, eps: float = 1e-9) -> np.ndarray | None:
    size = float(np.linalg.norm(v))
    return v / size if size > eps else None
