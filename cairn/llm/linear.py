"""Small linear models in numpy; they are fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights of a hinge-loss support vector machine, by dual coordinate descent; y is -1 or 1."""
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = np.einsum("ij,ij->i", x, x)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            if square[i] == 0:
                continue
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0.0), cost)
            if step := new - alpha[i]:
                w += step * y[i] * x[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def one_versus_rest(rows: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray, classes: int, size: int, cost: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """A support vector machine of each class against all others, a column each, the bias in the last row.

    ``rows`` are places and values below ``size``. All classes take the same dual coordinate step together, so a row is gathered once
    for all of them and no dense matrix of rows is made.
    """
    w = np.zeros((size + 1, classes))
    alpha = np.zeros((len(rows), classes), dtype=np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], size), np.append(rows[i][1], 1.0)
            y = np.where(np.arange(classes) == names[i], 1.0, -1.0)
            new = np.clip(alpha[i] - (y * (x @ w[at]) - 1) / (x @ x), 0.0, cost)
            step = new - alpha[i]
            some = np.flatnonzero(step)
            if len(some):
                w[np.ix_(at, some)] += np.outer(x, (step * y)[some])
                alpha[i] = new
                moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-4:
            break
    return w


class Ftrl:
    """FTRL-proximal logistic regression over sets of hashed features, with a learning rate for each coordinate."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias, without L1
        self.bias = size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, self.bias)
        w = self.weights(at)
        g = float(sigmoid(np.array(w.sum()))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Places and values of the weights that L1 left, and the bias."""
        w = self.weights(np.arange(self.bias + 1))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])
