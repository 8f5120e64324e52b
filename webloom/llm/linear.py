"""Small linear models trained with numpy on the driver, on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Sparse rows: for each row the features ``idx`` with weights ``val``, between offsets ``at``."""

    def __init__(self, idx: np.ndarray, val: np.ndarray, at: np.ndarray):
        self.idx, self.val, self.at = idx.astype(np.int32, copy=False), val.astype(np.float32, copy=False), at
        self.row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.idx] * self.val, len(self.at) - 1)

    def back(self, g: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.idx, g[self.row] * self.val, dims)

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.at)[rows]
        at = np.concatenate(([0], np.cumsum(n)))
        pick = np.repeat(self.at[:-1][rows] - at[:-1], n) + np.arange(at[-1])
        return Rows(self.idx[pick], self.val[pick], at)

    def then(self, other: Rows) -> Rows:
        """These rows and the other ones."""
        return Rows(np.concatenate((self.idx, other.idx)), np.concatenate((self.val, other.val)), np.concatenate((self.at, self.at[-1] + other.at[1:])))


class Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def logistic(x: Rows, y: np.ndarray, dims: int, steps: int = 150, rate: float = 0.1, l2: float = 1e-5, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression; ``y`` in 0..1."""
    w, opt = np.zeros(dims + 1), Adam(dims + 1, rate)
    weight = np.ones(len(y)) if weight is None else weight
    total = max(weight.sum(), 1e-9)
    for _ in range(steps):
        r = (sigmoid(x.dot(w[:-1]) + w[-1]) - y) * weight / total
        g = np.append(x.back(r, dims), r.sum())
        g[:-1] += l2 * w[:-1]
        opt.step(w, g)
    return w


def squared_hinge(x: Rows, y: np.ndarray, dims: int, steps: int = 200, rate: float = 0.1, l2: float = 1e-6) -> np.ndarray:
    """Weights and intercept of a linear support vector machine with squared hinge loss; ``y`` is -1 or 1, classes weigh alike."""
    w, opt = np.zeros(dims + 1), Adam(dims + 1, rate)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    for _ in range(steps):
        r = -2 * y * np.maximum(0, 1 - y * (x.dot(w[:-1]) + w[-1])) * weight
        g = np.append(x.back(r, dims), r.sum())
        g[:-1] += l2 * w[:-1]
        opt.step(w, g)
    return w


def dense_logistic(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.05, l2: float = 1e-3) -> np.ndarray:
    """Weights and intercept on a few dense columns (calibration, combination)."""
    w, opt = np.zeros(x.shape[1] + 1), Adam(x.shape[1] + 1, rate)
    for _ in range(steps):
        r = (sigmoid(x @ w[:-1] + w[-1]) - y) / max(len(y), 1)
        g = np.append(x.T @ r, r.sum())
        g[:-1] += l2 * w[:-1]
        opt.step(w, g)
    return w
