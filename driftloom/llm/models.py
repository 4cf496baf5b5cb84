"""Small models fitted on the driver from bounded samples: logistic regression by Newton steps."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Ridge logistic regression on standardized features; with one class only it returns the (smoothed) base rate."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 40):
        x, y = np.asarray(x, float), np.asarray(y, float)
        x = x[:, None] if x.ndim == 1 else x
        weight = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        self.mean = x.mean(0) if len(y) else np.zeros(x.shape[1])
        self.scale = np.where(x.std(0) > 1e-12, x.std(0), 1.0) if len(y) else np.ones(x.shape[1])
        self.w = np.zeros(x.shape[1] + 1)
        base = ((weight * y).sum() + 1) / (weight.sum() + 2)
        self.w[-1] = np.log(base / (1 - base))
        if len(np.unique(y)) < 2:
            return
        a = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        hold = np.full(len(self.w), ridge * weight.sum())
        hold[-1] = 0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-9) * weight
            step = np.linalg.solve((a.T * s) @ a + np.diag(hold + 1e-9), a.T @ (weight * (p - y)) + hold * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-9:
                break

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(-1, len(self.mean))
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)))


class Isotonic:
    """Monotone calibration of a score: pooled adjacent violators on the training points, linear between the pools.

    Each pool counts `prior` more points at the base rate, so that ends never reach 0 or 1."""

    def __init__(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, prior: float = 1.0):
        score, y = np.asarray(score, float), np.asarray(y, float)
        weight = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        base = ((weight * y).sum() + 1) / (weight.sum() + 2)
        self.x, self.p = np.zeros(1), np.array([base])
        if len(np.unique(y)) < 2:
            return
        order = np.lexsort((y, score))
        pools: list[list[float]] = []  # weighted sums of y, 1, score
        for s, t, w in zip(score[order], y[order], weight[order], strict=True):
            pools.append([w * t, w, w * s])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        got = np.array(pools)
        self.x, self.p = got[:, 2] / got[:, 1], (got[:, 0] + prior * base) / (got[:, 1] + prior)
        self.p = np.maximum.accumulate(self.p)

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.p)
