"""A small ridge-regularised logistic regression, fitted by Newton's method."""

from __future__ import annotations

import numpy as np


class Logistic:
    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
        """With one class or no rows, the score is the class (or 1/2)."""
        x, y = np.asarray(x, float).reshape(len(y), -1), np.asarray(y, float)
        self.mean = x.mean(0) if len(y) else np.zeros(x.shape[1])
        self.scale = x.std(0) + 1e-9 if len(y) else np.ones(x.shape[1])
        a = np.column_stack([np.ones(len(y)), (x - self.mean) / self.scale])
        self.w = np.zeros(a.shape[1])
        if not len(y):
            return self
        penalty = np.full(a.shape[1], ridge)
        penalty[0] = 1e-2
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * self.w)
            self.w = self.w - np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(-1, len(self.mean))
        z = self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
