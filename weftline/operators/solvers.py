"""Factorisations and solvers of tall tables and of matrices in cells, as Spark jobs.

A table of n rows and p columns is factored by a tree: each task reduces its
rows to a triangle of p x p, and triangles are stacked and reduced again, some
at a time, until one is left. Singular values and least squares follow from
that triangle, with the condition of the table itself and not of its square.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from weftline.errors import FitFailed, SolutionFailed
from weftline.operators.linalg import svd
from weftline.operators.matrix import matvec
from weftline.session import materialise

#: Triangles that one task stacks at a time.
FAN_IN = 32
#: Singular values below so much of the largest are what rounding leaves.
ROUNDING = 100 * np.finfo(float).eps


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The p x p factor R of some rows, its diagonal not negative."""
    p = rows.shape[1]
    r = np.linalg.qr(np.vstack((rows, np.zeros((max(0, p - len(rows)), p)))), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _packed(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["part", "r"])


def _merge(p: int):
    def run(table: pa.Table) -> pa.Table:
        r = np.zeros((0, p))
        for v in table["r"]:
            r = _triangle(np.vstack((r, np.frombuffer(v.as_py(), "<f8").reshape(p, p))))
        return pa.Table.from_batches([_packed(table["part"][0].as_py() // FAN_IN, r)])

    return run


def triangle(df: DataFrame, columns: Sequence[str], center: Sequence[float] | None = None) -> np.ndarray:
    """The factor R of the rows of some columns, less ``center``; rows with a null are left out.

    R'R is the (centred) Gram matrix, of which R is the Cholesky factor.
    """
    p, mid = len(columns), np.zeros(len(columns)) if center is None else np.asarray(center, float)

    def run(batches):
        r = np.zeros((0, p))
        for b in batches:
            r = _triangle(np.vstack((r, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1) - mid)))
        if len(r):
            yield _packed(TaskContext.get().partitionId(), r)

    x = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).dropna()
    parts = materialise(x.mapInArrow(run, "part long, r binary"), "triangles")
    while parts.count() > FAN_IN:
        parts = materialise(parts.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(_merge(p), "part long, r binary"), "triangles")
    rows = [np.frombuffer(r.r, "<f8").reshape(p, p) for r in sorted(parts.collect())]
    if not rows:
        raise FitFailed("a table without rows has no factors")
    return _triangle(np.vstack(rows))


@dataclass(frozen=True)
class TallQR:
    columns: tuple[str, ...]
    r: np.ndarray

    def q(self, df: DataFrame, name: str = "q") -> DataFrame:
        """``df`` with the rows of Q, an array in ``name``: each row times the inverse of R."""
        s = np.linalg.svd(self.r, compute_uv=False)
        if s[-1] <= ROUNDING * s[0]:
            raise SolutionFailed("columns depend on each other, so Q is not determined")
        back = np.linalg.inv(self.r)
        out = [sum((F.col(c).cast("double") * float(back[i, j]) for i, c in enumerate(self.columns[: j + 1])), F.lit(0.0)) for j in range(len(self.columns))]
        return df.withColumn(name, F.array(*out))


def qr(df: DataFrame, columns: Sequence[str]) -> TallQR:
    return TallQR(tuple(columns), triangle(df, columns))


@dataclass(frozen=True)
class TallSVD:
    """Singular values s in descending order and right vectors as columns of v."""

    columns: tuple[str, ...]
    s: np.ndarray
    v: np.ndarray

    def u(self, df: DataFrame, name: str = "u") -> DataFrame:
        """``df`` with the rows of U for the singular values that are not zero."""
        keep = np.flatnonzero(self.s > ROUNDING * self.s[0])
        out = [sum((F.col(c).cast("double") * float(self.v[i, j] / self.s[j]) for i, c in enumerate(self.columns)), F.lit(0.0)) for j in keep]
        return df.withColumn(name, F.array(*out))


def tall_svd(df: DataFrame, columns: Sequence[str]) -> TallSVD:
    """Each right vector's largest component is positive."""
    found = svd(triangle(df, columns))
    v = found.v * np.sign(found.v[np.abs(found.v).argmax(0), np.arange(len(columns))])
    return TallSVD(tuple(columns), found.s, v)


def least_squares(df: DataFrame, columns: Sequence[str], y: str, center: Sequence[float] | None = None, solver: str = "svd") -> np.ndarray:
    """Weights of least squares, of least norm by ``svd``; ``qr`` asks for independent columns."""
    r = triangle(df, [*columns, y], center)
    x, t = r[:-1, :-1], r[:-1, -1]
    if solver == "qr":
        s = np.linalg.svd(x, compute_uv=False)
        if s[-1] <= ROUNDING * s[0]:
            raise FitFailed("the columns depend on each other")
        return np.linalg.solve(x, t)
    if solver != "svd":
        raise FitFailed(f"unknown solver {solver}")
    found = svd(x)
    keep = found.s > ROUNDING * found.s[0]
    return found.v[:, keep] @ (found.u[:, keep].T @ t / found.s[keep])


def biconjugate_gradient(a: DataFrame, b: DataFrame, tol: float = 1e-10, max_iter: int = 1000) -> tuple[DataFrame, float, int]:
    """((i, value), relative residual, steps) of the system with the cells ``a`` (i, j, value) and the right side ``b`` (i, value).

    The residual is kept orthogonal to the Krylov space of the transposed system,
    whose shadow residual and direction run along; both are scaled by the
    diagonal. All vectors stay tables: a step is two products, and two sums
    reach the driver. Cells and entries that are missing count as zero.
    """
    if tol <= 0 or max_iter < 1:
        raise SolutionFailed(f"tol and max_iter must be positive, got {tol} and {max_iter}")
    diagonal = a.where("i = j").groupBy("i").agg(F.sum("value").alias("d"))
    every = a.select("i").union(a.select(F.col("j").alias("i"))).union(b.select("i")).distinct()
    entry = every.join(b.groupBy("i").agg(F.sum("value").alias("r")), "i", "left").join(diagonal, "i", "left")
    scale = F.when(F.coalesce("d", F.lit(0.0)) == 0, 1.0).otherwise(F.col("d"))
    residual = F.coalesce("r", F.lit(0.0)).cast("double")
    v = entry.select("i", scale.alias("d"), F.lit(0.0).alias("x"), residual.alias("r"), residual.alias("shadow"))
    v = materialise(v.withColumns({"to": F.col("r") / F.col("d"), "shadow_to": F.col("shadow") / F.col("d")}), "krylov")
    size, inner = v.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))), F.sum(F.col("r") * F.col("shadow") / F.col("d"))).first()
    if not size:
        return v.select("i", F.col("x").alias("value")), 0.0, 0
    left, steps = 1.0, 0
    for steps in range(1, max_iter + 1):
        along = matvec(a, v.select("i", F.col("to").alias("value"))).withColumnRenamed("value", "along")
        across = matvec(a, v.select("i", F.col("shadow_to").alias("value")), transpose_a=True).withColumnRenamed("value", "across")
        moved = materialise(v.join(along, "i", "left").join(across, "i", "left").fillna(0.0, ["along", "across"]), "krylov")
        curve = moved.agg(F.sum(F.col("shadow_to") * F.col("along"))).first()[0]
        if not curve:
            raise SolutionFailed("the iteration broke down: a direction has no curvature")
        t = F.lit(inner / curve)
        moved = moved.withColumns({"x": F.col("x") + t * F.col("to"), "r": F.col("r") - t * F.col("along"), "shadow": F.col("shadow") - t * F.col("across")})
        norm, new = moved.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))), F.sum(F.col("r") * F.col("shadow") / F.col("d"))).first()
        keep = F.lit(new / inner)
        to, shadow_to = F.col("r") / F.col("d") + keep * F.col("to"), F.col("shadow") / F.col("d") + keep * F.col("shadow_to")
        v = moved.select("i", "d", "x", "r", "shadow", to.alias("to"), shadow_to.alias("shadow_to"))
        left, inner = norm / size, new
        if left <= tol or not inner:
            break
    return materialise(v.select("i", F.col("x").alias("value")), "solution"), float(left), steps
