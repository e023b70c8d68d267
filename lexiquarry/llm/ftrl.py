"""FTRL-proximal learning: per-coordinate rates, L1 sparsity and L2 shrinkage.

Weights are never stored while learning; they follow from the sums z and n of a
coordinate: w = 0 where |z| <= l1, else -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2)."""

from __future__ import annotations

import numpy as np


class Ftrl:
    def __init__(self, shape, alpha: float, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(shape, np.float64)
        self.n = np.zeros(shape, np.float64)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, at, w: np.ndarray, g: np.ndarray) -> None:
        """One gradient at distinct coordinates whose weights are w."""
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more
