"""Platt scaling: from a classifier's logits to probabilities."""

from __future__ import annotations

import numpy as np


SMOOTH = 0.1  # rows of the other label that each label is thought to hold
HELD = 20  # with fewer held-back rows of a label, a model is calibrated on all rows


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that sum to a half for each of the labels 0 and 1; other values have none."""
    return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), np.where(y == 0, 0.5 / max(1, (y == 0).sum()), 0.0))


def platt(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """(slope, shift) from logits of rows labelled y to probabilities at `share` of label 1: labels weigh alike, targets are
    smoothed by a part of a row each, and Newton steps are halved until the loss falls, so separable rows end as well."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target, weight = np.where(y == 1, (n1 + SMOOTH) / (n1 + 2 * SMOOTH), SMOOTH / (n0 + 2 * SMOOTH)), balanced(y) * len(y)
    spread = float(z.std()) or 1.0
    x, ridge = z / spread, 1e-2

    def loss(p: np.ndarray) -> float:
        s = p[0] * x + p[1]
        return float((weight * (np.logaddexp(0, s) - target * s)).sum() + ridge / 2 * (p @ p))

    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        q, r = weight * p * (1 - p), weight * (p - target)
        grad = np.array([(r * x).sum(), r.sum()]) + ridge * at
        hess = np.array([[(q * x * x).sum(), (q * x).sum()], [(q * x).sum(), q.sum()]]) + ridge * np.eye(2)
        step, now = np.linalg.solve(hess, grad), loss(at)
        while loss(at - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    share = min(max(share, 1e-3), 1 - 1e-3)
    return float(at[0] / spread), float(at[1] + np.log(share / (1 - share)))
