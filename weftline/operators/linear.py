"""Linear models from one Gram aggregation and a small solve; prediction is an expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from weftline.errors import FitFailed
from weftline.operators.linalg import cholesky_solve, gram, svd
from weftline.operators.solvers import least_squares


@dataclass(frozen=True)
class LinearModel:
    columns: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    converged: bool = True
    n_iter: int = 0

    def expression(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(self.columns, self.coefficients, strict=True):
            out = out + F.col(c).cast("double") * float(w)
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.expression())


def _parts(df: DataFrame, columns: Sequence[str], y: str):
    g = gram(df, [*columns, y])
    return g, g.cross[:-1, :-1], g.cross[:-1, -1], g.mean[:-1], g.mean[-1]


#: Columns up to which least squares first tries the Gram matrix, and the condition of the scaled one up to which it is kept.
GRAM_COLUMNS, GRAM_CONDITION = 16, 1e6


def linear_regression(df: DataFrame, columns: Sequence[str], y: str, solver: str = "svd") -> LinearModel:
    """Ordinary least squares; ``svd`` gives the least-norm solution of deficient data, ``qr`` an error.

    A few columns far from dependent are solved from their centred Gram matrix, one
    aggregation; all others from the table's triangle, whose condition is not squared.
    """
    if solver not in ("svd", "qr"):
        raise FitFailed(f"unknown solver {solver}")
    if len(columns) <= GRAM_COLUMNS:
        g, xx, xy, mx, my = _parts(df, columns, y)
        sd = np.sqrt(np.maximum(np.diag(xx), 0))
        if (sd > 0).all():
            scaled = xx / np.outer(sd, sd)
            ends = np.linalg.eigvalsh(scaled)[[0, -1]]
            if ends[0] * GRAM_CONDITION > ends[1]:
                w = np.linalg.solve(scaled, xy / sd) / sd
                return LinearModel(tuple(columns), tuple(w.tolist()), float(my - w @ mx))
    names = [*columns, y]
    whole = df.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna()
    means = whole.agg(*(F.avg(c) for c in names)).first()
    if means[0] is None:
        raise FitFailed("there are no rows")
    w = least_squares(whole, columns, y, list(means), solver)
    return LinearModel(tuple(columns), tuple(w.tolist()), float(means[-1] - w @ np.array(means[:-1])))


def _scaled(g, xx, xy, columns):
    sd = g.std[:-1]
    flat = [c for c, s in zip(columns, sd, strict=True) if s < np.finfo(float).eps]
    if flat:
        raise FitFailed(f"column {flat[0]} has no variance to be scaled by")
    return sd, xx / np.outer(sd, sd), xy / sd


def ridge_regression(df: DataFrame, columns: Sequence[str], y: str, alpha: float = 1.0, normalize: bool = True, solver: str = "cholesky") -> LinearModel:
    """Least squares with alpha ||w||^2; without ``normalize`` there is no intercept and no centring."""
    g, xx, xy, mx, my = _parts(df, columns, y)
    if g.n <= len(columns):
        raise FitFailed(f"more rows than the {len(columns)} columns are needed")
    solve = cholesky_solve if solver == "cholesky" else lambda a, b: svd(a).solve(b)
    eye = np.eye(len(columns))
    if normalize:
        sd, zz, zy = _scaled(g, xx, xy, columns)
        w = solve(zz + alpha * eye, zy) / sd
        return LinearModel(tuple(columns), tuple(w.tolist()), float(my - w @ mx))
    w = solve(xx + g.n * np.outer(mx, mx) + alpha * eye, xy + g.n * mx * my)
    return LinearModel(tuple(columns), tuple(w.tolist()), 0.0)


def coordinate_descent(q: np.ndarray, c: np.ndarray, l1: float, l2: float, tol: float, max_iter: int) -> tuple[np.ndarray, bool, int]:
    """Minimise w'Qw - 2c'w + l1 |w|_1 + l2 |w|^2."""
    w, it, moved = np.zeros(len(c)), 0, True
    for it in range(1, max_iter + 1):
        largest = 0.0
        for j in range(len(c)):
            r = c[j] - q[j] @ w + q[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - l1 / 2, 0) / (q[j, j] + l2) if q[j, j] + l2 > 0 else 0.0
            largest = max(largest, abs(new - w[j]) * np.sqrt(max(q[j, j], 1e-300)))
            w[j] = new
        moved = largest > tol * max(1.0, np.sqrt(np.abs(w) @ np.abs(q) @ np.abs(w)))
        if not moved:
            break
    return w, not moved, it


def _checked(alpha: float, tol: float, max_iter: int) -> None:
    if alpha < 0:
        raise FitFailed(f"alpha is {alpha}, but a penalty cannot be negative")
    if tol <= 0:
        raise FitFailed(f"tol is {tol}, but must be positive")
    if max_iter <= 0:
        raise FitFailed(f"max_iter is {max_iter}, but at least one pass is needed")


def elastic_net(df: DataFrame, columns: Sequence[str], y: str, alpha: float = 1.0, l1_ratio: float = 0.5, normalize: bool = True, tol: float = 1e-8, max_iter: int = 10_000, compat: bool = False) -> LinearModel:
    """min |y_c - Zw|^2 + alpha r n |w|_1 + alpha (1 - r) n |w|^2 on centred data.

    ``compat`` adds the linear term that centring over n + p augmented targets
    brings. Without ``normalize`` the intercept is the mean of y.
    """
    _checked(alpha, tol, max_iter)
    g, xx, xy, mx, my = _parts(df, columns, y)
    n, p = g.n, len(columns)
    l1, l2 = alpha * l1_ratio * n, alpha * (1 - l1_ratio) * n
    if normalize:
        sd, q, c = _scaled(g, xx, xy, columns)
    else:
        sd, q, c = np.ones(p), xx + n * np.outer(mx, mx), xy
    if compat:
        c = c - np.sqrt(l2) * n * my / (n + p)
    w, ok, it = coordinate_descent(q, c, l1, l2, tol, max_iter)
    w = w / sd
    return LinearModel(tuple(columns), tuple(w.tolist()), float(my - w @ mx if normalize else my), ok, it)


def lasso(df: DataFrame, columns: Sequence[str], y: str, alpha: float = 1.0, normalize: bool = True, tol: float = 1e-8, max_iter: int = 10_000) -> LinearModel:
    """min |y_c - Zw|^2 + alpha n |w|_1."""
    if df.limit(len(columns) + 1).count() <= len(columns):
        raise FitFailed(f"more rows than the {len(columns)} columns are needed")
    return elastic_net(df, columns, y, alpha, 1.0, normalize, tol, max_iter)
