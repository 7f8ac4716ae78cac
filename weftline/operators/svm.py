"""Support vector machines over all rows.

``svc`` and ``svr`` are the machines of the kernel itself, by ``operators/svm_dual.py``.
Where ``landmarks`` is given they are approximate: the machine is fitted in the
space that so many sampled rows, the landmarks, span: a row becomes its kernel values with the landmarks, turned so
that inner products there approach the kernel (they equal it if every distinct
row is a landmark). The machine is then linear, and objective and gradient
over all rows are one aggregation an evaluation; no row but the landmarks
reaches the driver. The corner of the loss is rounded over a width that shrinks
from one search to the next.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.errors import FitFailed
from weftline.operators import pairs
from weftline.operators.optimize import lbfgs
from weftline.operators.svm_rounds import kernel_values
from weftline.session import materialise

#: Components of support vectors that a model holds; more stay a table.
HELD_VALUES = 1 << 20
#: Rows and support vectors of a chunk that are compared in one task.
CHUNK_ROWS = 16_384
#: Support vectors that are literals of a plan; more are scored in Arrow batches.
PLAN_VECTORS = 16
#: Widths over which the corner of the loss is rounded, in turn.
WIDTHS = (0.5, 0.05)
_ROW, _SUM = "__row", "__sum"


@dataclass(frozen=True)
class SupportVectors:
    kernel: object
    vectors: np.ndarray
    weights: np.ndarray
    bias: float

    def decision(self, features: Column) -> Column:
        """sum(w_i K(x_i, x)) + b."""
        v = features.cast("array<double>")
        if not len(self.vectors):
            return F.lit(float(self.bias))
        if len(self.vectors) > PLAN_VECTORS:
            kernel, vectors, weights, bias = self.kernel, self.vectors, self.weights, float(self.bias)

            def score(x: pd.Series) -> pd.Series:
                return pd.Series(kernel_values(kernel, np.stack(x.to_numpy()), vectors, weights) + bias) if len(x) else pd.Series([], dtype=float)

            return F.pandas_udf(score, "double")(v)
        rows = F.array(*(F.struct(F.lit(float(w)).alias("w"), F.array(*(F.lit(float(x)) for x in s)).alias("s")) for w, s in zip(self.weights, self.vectors, strict=True)))
        return F.aggregate(rows, F.lit(float(self.bias)), lambda a, r: a + r["w"] * self.kernel.column(r["s"], v))

    def predict_class(self, df: DataFrame, features: str = "features", name: str = "prediction") -> DataFrame:
        """1 above zero, else -1."""
        return df.withColumn(name, F.when(self.decision(F.col(features)) > 0, 1).otherwise(-1))

    def predict_value(self, df: DataFrame, features: str = "features", name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.decision(F.col(features)))


@dataclass(frozen=True)
class SupportTable:
    """A machine whose support vectors (at, v, weight) are too many for one place; rows meet them in chunks."""

    kernel: object
    table: DataFrame = field(repr=False)
    number: int
    dims: int
    bias: float

    def predict_value(self, df: DataFrame, features: str = "features", name: str = "prediction") -> DataFrame:
        rows = materialise(df.withColumn(_ROW, F.monotonically_increasing_id()), "scored")
        a, b = (pairs.chunks(n, self.dims, CHUNK_ROWS) for n in (self.number, rows.count()))
        kernel = self.kernel

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            value = kernel_values(kernel, pairs.vectors(right["q"]), pairs.vectors(left["v"]), left["weight"].to_numpy())
            return pa.table({"row": right["row"], "value": pa.array(value)})

        marks = self.table.select("v", "weight", pairs.part_of("at", a).alias("rc"), pairs.upto(b).alias("qc"))
        asked = rows.select(F.col(_ROW).alias("row"), F.col(features).cast("array<double>").alias("q")).where("q is not null")
        asked = asked.select("*", pairs.part_of("row", b).alias("qc"), pairs.upto(a).alias("rc"))
        sums = pairs.meet(marks, asked, ["rc", "qc"], a * b, work, "row long, value double").groupBy(F.col("row").alias(_ROW)).agg((F.sum("value") + F.lit(float(self.bias))).alias(_SUM))
        return rows.join(sums, _ROW, "left").withColumn(name, F.col(_SUM)).drop(_ROW, _SUM)

    def predict_class(self, df: DataFrame, features: str = "features", name: str = "prediction") -> DataFrame:
        """1 above zero, else -1."""
        return self.predict_value(df, features, name).withColumn(name, F.when(F.col(name) > 0, 1).otherwise(-1))


def _rows(df: DataFrame, features: str, y: str, kernel) -> DataFrame:
    if kernel is None:
        raise FitFailed("a machine needs a kernel")
    rows = df.select(F.col(features).cast("array<double>").alias("v"), F.col(y).cast("double").alias("y")).where("v is not null and y is not null")
    return materialise(rows, "machine")


def _landmarks(rows: DataFrame, most: int) -> np.ndarray:
    """The first ``most`` distinct vectors in the order of a hash; equal vectors meet before the order is taken."""
    got = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(most).collect()
    if not got:
        raise FitFailed("there are no rows")
    return np.array([r.v for r in got])


def _rounded(z: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """max(z, 0) with its corner rounded over ``width``, and the slope."""
    slope = np.clip(z / width, 0, 1)
    return np.where(z < width, slope * z / 2, z - width / 2), slope


def _fit(rows: DataFrame, kernel, c: float, eps: float | None, tol: float, max_iter: int, landmarks: int) -> SupportVectors:
    """min 1/2 |w|^2 + c sum(loss); the loss is the hinge, or with ``eps`` what leaves a band of that half width."""
    marks = _landmarks(rows, landmarks)
    d, u = np.linalg.eigh(kernel.matrix(marks, marks))
    keep = d > max(d.max(), 0) * 1e-10
    if not keep.any():
        raise FitFailed("the kernel is zero on all landmarks")
    turn = u[:, keep] / np.sqrt(d[keep])
    m = turn.shape[1]

    def passed(f, size: int) -> np.ndarray:
        """Sums over all rows of the ``size`` numbers that ``f`` makes of mapped rows and targets."""

        def run(batches):
            total = np.zeros(size)
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    v = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    total += f(kernel.matrix(v, marks) @ turn, part.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int64()), pa.array(total)], names=["i", "s"])

        got = {r.i: r.s for r in rows.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
        return np.array([got[i] for i in range(size)])

    first = passed(lambda x, y: np.concatenate((x.sum(0), [len(y), y.sum()])), m + 2)
    n, mean, middle = first[m], first[:m] / first[m], first[m + 1] / first[m]
    spread = passed(lambda x, y: ((x - mean) ** 2).sum(0), m)
    # Variables are scaled by what the loss would curve them at most, so that one length fits all.
    scale = 1 / np.sqrt(1 + c * spread)
    tall = 1 / np.sqrt(max(c * n, 1e-300))
    at = np.zeros(m + 1)
    at[m] = (middle if eps is not None else 0.0) / tall
    for width in WIDTHS:

        def objective(q: np.ndarray, width: float = width) -> tuple[float, np.ndarray]:
            w, b = q[:m] * scale, q[m] * tall

            def part(x, y):
                x = x - mean
                t = x @ w + b
                if eps is None:
                    loss, slope = _rounded(1 - y * t, width)
                    slope = -y * slope
                else:
                    over, up = _rounded(t - y - eps, width)
                    under, down = _rounded(y - t - eps, width)
                    loss, slope = over + under, up - down
                return np.concatenate(([loss.sum(), slope.sum()], slope @ x))

            s = passed(part, m + 2)
            return float(0.5 * w @ w + c * s[0]), np.concatenate(((w + c * s[2:]) * scale, [c * s[1] * tall]))

        at = lbfgs(objective, at, max_iter=max_iter, g_tol=tol, f_rtol=1e-9).x
    w, b = at[:m] * scale, at[m] * tall
    return SupportVectors(kernel, marks, turn @ w, float(b - w @ mean))


def svc(df: DataFrame, features: str, y: str, kernel, c: float = 1.0, tol: float = 1e-3, max_iter: int = 200, landmarks: int | None = None) -> SupportVectors | SupportTable:
    """A two-class machine over all rows with labels -1 and 1; rows with a null are left out.

    It is the kernel's own, to a gap of ``tol`` of the objective; with ``landmarks``
    an approximation, by at most ``max_iter`` steps.
    """
    rows = _rows(df, features, y, kernel)
    if {r.y for r in rows.select("y").distinct().limit(3).collect()} != {-1.0, 1.0}:
        raise FitFailed("the two classes are told by -1 and 1, and both must occur")
    return _whole(rows, kernel, c, None, tol) if landmarks is None else _fit(rows, kernel, c, None, tol, max_iter, landmarks)


def svr(df: DataFrame, features: str, y: str, kernel, eps: float = 0.1, c: float = 1.0, tol: float = 1e-3, max_iter: int = 200, landmarks: int | None = None) -> SupportVectors | SupportTable:
    """Regression over all rows with an insensitive band of width eps on each side; ``landmarks`` as for ``svc``."""
    rows = _rows(df, features, y, kernel)
    return _whole(rows, kernel, c, eps, tol) if landmarks is None else _fit(rows, kernel, c, eps, tol, max_iter, landmarks)


def _whole(rows: DataFrame, kernel, c: float, eps: float | None, tol: float) -> SupportVectors | SupportTable:
    from weftline.operators import svm_dual  # it has the machines of this module

    return svm_dual.machine(rows.select(F.lit(0).cast("long").alias("id"), "v", "y"), kernel, c, eps, tol, proved=False).machine
