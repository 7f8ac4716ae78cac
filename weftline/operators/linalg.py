"""The Gram aggregation, and the factorisations of the column-sized matrices that aggregations leave.

Rows of a table never reach the driver: a model needs sums over rows whose size
depends on the number of columns alone. Tall tables are factored in ``solvers``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.errors import DecompositionFailed, FitFailed, SolutionFailed

#: Up to so many columns the sums are plain expressions; beyond it tasks add up Arrow batches.
PLAIN_COLUMNS = 12


@dataclass(frozen=True)
class Gram:
    """n, column means, and the centred cross products of all columns."""

    columns: tuple[str, ...]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def covariance(self, sample: bool = True) -> np.ndarray:
        return self.cross / (self.n - 1 if sample else self.n)

    @property
    def std(self) -> np.ndarray:
        """Population deviations."""
        return np.sqrt(np.maximum(np.diag(self.cross), 0) / self.n)


def gram(df: DataFrame, columns: Sequence[str]) -> Gram:
    """One pass for the means, one for the centred cross products; rows with a null are left out."""
    cols = tuple(columns)
    x = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols))).dropna()
    names = x.columns
    row = x.agg(F.count(F.lit(1)), *(F.avg(c) for c in names)).first()
    n, mean = row[0], np.array([0.0 if v is None else v for v in row[1:]])
    if n == 0:
        raise FitFailed("there are no rows")
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    if p <= PLAIN_COLUMNS:
        at = lambda i: F.col(names[i]) - float(mean[i])
        sums = list(x.agg(*(F.sum(at(i) * at(j)).alias(f"s{i}_{j}") for i, j in pairs)).first())
    else:

        def run(batches):
            total = np.zeros((p, p))
            for b in batches:
                m = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1) - mean
                total += m.T @ m
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int32()), pa.array([j for _, j in pairs], pa.int32()), pa.array([total[i, j] for i, j in pairs])], names=["i", "j", "s"])

        got = {(r.i, r.j): r.s for r in x.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
        sums = [got[q] for q in pairs]
    cross = np.zeros((p, p))
    for (i, j), s in zip(pairs, sums, strict=True):
        cross[i, j] = cross[j, i] = s
    return Gram(cols, n, mean, cross)


def cholesky(a: np.ndarray) -> np.ndarray:
    """The lower factor of a symmetric positive definite matrix."""
    a = np.asarray(a, float)
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise DecompositionFailed("only square matrices have a Cholesky factor")
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError as e:
        raise DecompositionFailed("the matrix is not positive definite") from e


def cholesky_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = cholesky(a)
    return np.linalg.solve(low.T, np.linalg.solve(low, np.asarray(b, float)))


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(L, U, P) with P A = L U, by partial pivoting."""
    u = np.array(a, float)
    n, m = u.shape
    low, order = np.eye(n, min(n, m)), np.arange(n)
    for k in range(min(n, m)):
        top = k + int(np.argmax(np.abs(u[k:, k])))
        if top != k:
            u[[k, top]], order[[k, top]] = u[[top, k]], order[[top, k]]
            low[[k, top], :k] = low[[top, k], :k]
        if u[k, k] != 0:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return low, np.triu(u[: min(n, m)]), np.eye(n)[order]


def lu_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(np.asarray(a, float), np.asarray(b, float))
    except np.linalg.LinAlgError as e:
        raise SolutionFailed("the matrix is singular") from e


def inverse(a: np.ndarray) -> np.ndarray:
    return lu_solve(a, np.eye(len(a)))


def qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Q, R) by Householder reflections."""
    return np.linalg.qr(np.asarray(a, float))


def qr_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    q, r = qr(a)
    if np.any(np.abs(np.diag(r)) <= np.finfo(float).eps * np.abs(r).max()):
        raise SolutionFailed("the matrix is rank deficient")
    return np.linalg.solve(r, q.T @ np.asarray(b, float))


@dataclass(frozen=True)
class SVD:
    u: np.ndarray
    s: np.ndarray
    v: np.ndarray

    @property
    def tolerance(self) -> float:
        return 0.5 * np.sqrt(len(self.u) + len(self.v) + 1.0) * self.s[0] * np.finfo(float).eps

    def solve(self, b: np.ndarray) -> np.ndarray:
        """The least-norm solution; singular values within the tolerance count as zero."""
        keep = self.s > self.tolerance
        return self.v[:, keep] @ ((self.u[:, keep].T @ np.asarray(b, float)).T / self.s[keep]).T


def svd(a: np.ndarray) -> SVD:
    u, s, vt = np.linalg.svd(np.asarray(a, float), full_matrices=False)
    return SVD(u, s, vt.T)


@dataclass(frozen=True)
class EVD:
    """Eigenvalues d + e i in descending order of d, and eigenvectors as columns."""

    d: np.ndarray
    e: np.ndarray
    v: np.ndarray


def evd(a: np.ndarray, symmetric: bool) -> EVD:
    a = np.asarray(a, float)
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise DecompositionFailed("the matrix is not square")
    w, v = np.linalg.eigh(a) if symmetric else np.linalg.eig(a)
    order = np.argsort(-w.real, kind="stable")
    return EVD(w.real[order], w.imag[order], v[:, order])
