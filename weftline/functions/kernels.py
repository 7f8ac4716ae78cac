"""Kernels of two packed vectors, as columns and, for solvers, as matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

from weftline.functions.distance import squared_euclidian, squared_matrix
from weftline.functions.vectors import dot


@dataclass(frozen=True)
class Linear:
    def column(self, a: Column, b: Column) -> Column:
        return dot(a, b)

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a @ b.T


@dataclass(frozen=True)
class RBF:
    gamma: float

    def column(self, a: Column, b: Column) -> Column:
        return F.exp(-self.gamma * squared_euclidian(a, b))

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * squared_matrix(a, b))

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``matrix`` by products of the rows around the middle of b, faster and exact to rounding of their lengths."""
        middle = b.mean(0) if len(b) else 0.0
        a, b = a - middle, b - middle
        d = a @ b.T
        d *= -2
        d += (a * a).sum(1)[:, None]
        d += (b * b).sum(1)[None, :]
        np.maximum(d, 0, out=d)
        d *= -self.gamma
        return np.exp(d, out=d)


@dataclass(frozen=True)
class Polynomial:
    degree: float
    gamma: float
    coef0: float = 1.0

    def column(self, a: Column, b: Column) -> Column:
        return F.pow(self.gamma * dot(a, b) + self.coef0, F.lit(float(self.degree)))

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.gamma * (a @ b.T) + self.coef0) ** self.degree


@dataclass(frozen=True)
class Sigmoid:
    """tanh(gamma x.y + coef0), or with ``compat`` gamma x.y + tanh(coef0)."""

    gamma: float
    coef0: float = 1.0
    compat: bool = False

    def column(self, a: Column, b: Column) -> Column:
        if self.compat:
            return self.gamma * dot(a, b) + F.lit(float(np.tanh(self.coef0)))
        return F.tanh(self.gamma * dot(a, b) + self.coef0)

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.compat:
            return self.gamma * (a @ b.T) + np.tanh(self.coef0)
        return np.tanh(self.gamma * (a @ b.T) + self.coef0)
