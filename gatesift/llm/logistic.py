"""A logistic regression for a few columns and a bounded number of rows."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Weights of standardised columns, fitted by Newton steps with a ridge penalty."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def fit(cls, x, y, ridge: float = 1.0, steps: int = 30) -> Logistic:
        """Without rows the score is 0.5, with one class a smoothed share of label 1."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        width = x.shape[1] if x.ndim == 2 else 0
        if len(set(y.tolist())) < 2:
            share = (y.sum() + 1) / (len(y) + 2)
            return cls(np.zeros(width), np.ones(width),
                       np.append(np.zeros(width), np.log(share / (1 - share))))
        mean, scale = x.mean(0), x.std(0)
        scale[scale == 0] = 1
        a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w, penalty = np.zeros(width + 1), np.append(np.full(width, ridge), 1e-6)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
            step = np.linalg.solve(hessian, a.T @ (p - y) + penalty * w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def score(self, x):
        """Probability of label 1 for each row."""
        x = np.asarray(x, float).reshape(-1, len(self.mean))
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
