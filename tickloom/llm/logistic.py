"""Logistic regression by iteratively reweighted least squares in NumPy, on a sample or by sums over parts of the rows."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Logistic:
    """Standardised inputs, ridge penalty on all but the intercept. Without rows of both classes: the smoothed share."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, turns: int = 25):
        weight = np.ones(len(y)) if weight is None else weight
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.scale = np.where((s := x.std(0)) > 1e-9, s, 1.0) if len(x) else np.ones(x.shape[1])
        share = (weight @ y + 0.5) / (weight.sum() + 1) if len(y) else 0.5
        self.w = np.zeros(x.shape[1] + 1)
        self.w[-1] = np.log(share / (1 - share))
        if len(np.unique(y)) < 2:
            return
        for _ in range(turns):
            if self.step(*self.sums(x, y, weight), ridge) < 1e-7:
                break

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Curvature and gradient of the log likelihood, which add up over parts of the rows."""
        d = self._design(x)
        p = sigmoid(d @ self.w)
        return (d * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ d, d.T @ (weight * (y - p))

    def step(self, curvature: np.ndarray, gradient: np.ndarray, ridge: float = 1.0) -> float:
        """One turn of Newton's method; the largest change that it asks for."""
        penalty = np.full(len(self.w), ridge)
        penalty[-1] = 1e-6
        step = np.linalg.solve(curvature + np.diag(penalty), gradient - penalty * self.w)
        most = np.abs(step).max()
        self.w = self.w + step * min(1.0, 5 / max(most, 1e-9))
        return most

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.w

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))
