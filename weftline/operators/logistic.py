"""Logistic regression: each evaluation of objective and gradient is one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.errors import FitFailed
from weftline.functions.scalar import sigmoid
from weftline.operators.optimize import lbfgs, newton
from weftline.session import materialise

#: Classes that a model may have.
MAX_CLASSES = 1000
#: Columns of a model whose second derivatives are summed.
NEWTON_COLUMNS = 200


@dataclass(frozen=True)
class LogisticModel:
    """``coefficients`` has one row for two classes and else a row a class."""

    columns: tuple[str, ...]
    classes: tuple
    coefficients: np.ndarray
    intercept: np.ndarray
    converged: bool = True
    n_iter: int = 0

    def margins(self) -> list[Column]:
        out = []
        for w, b in zip(self.coefficients, self.intercept, strict=True):
            e = F.lit(float(b))
            for c, x in zip(self.columns, w, strict=True):
                e = e + F.col(c).cast("double") * float(x)
            out.append(e)
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """The second class above 0.5 of two; of more the first largest margin."""
        m = self.margins()
        if len(self.classes) == 2:
            return df.withColumn(name, F.when(sigmoid(m[0]) > 0.5, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))
        best = F.array_position(F.array(*m), F.array_max(F.array(*m))).cast("int")
        return df.withColumn(name, F.element_at(F.array(*(F.lit(c) for c in self.classes)), best))


def objective(rows: DataFrame, p: int, k: int, alpha: float, sd: np.ndarray | None = None, curved: bool = False):
    """f(w) -> (loss, gradient) over rows (y: class number, x0 .. x{p-1}); ``w`` is flat, biases last in each row.

    ``sd`` are the deviations by which the columns were divided; the penalty is on
    the weights before. With ``curved``, for two classes, the Hessian comes third.
    """
    sd = np.ones(p) if sd is None else sd
    ridge = np.append(alpha / sd**2, 0.0)

    def evaluate(w: np.ndarray):
        weights = w.reshape(-1, p + 1)
        size = 1 + weights.size + (p + 1) ** 2 * curved

        def run(batches):
            loss, grad, bend = 0.0, np.zeros_like(weights), np.zeros((p + 1, p + 1))
            for b in batches:
                y = b.column(0).to_numpy(zero_copy_only=False)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]] + [np.ones(b.num_rows)], 1)
                z = x @ weights.T
                if k == 2:
                    z = z[:, 0]
                    q = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    loss += float((np.logaddexp(0, z) - y * z).sum())
                    grad[0] += (q - y) @ x
                    if curved:
                        bend += (x * (q * (1 - q))[:, None]).T @ x
                else:
                    top = z.max(1, keepdims=True)
                    e = np.exp(z - top)
                    s = e.sum(1, keepdims=True)
                    loss += float((top[:, 0] + np.log(s[:, 0]) - z[np.arange(len(y)), y]).sum())
                    q = e / s
                    q[np.arange(len(y)), y] -= 1
                    grad += q.T @ x
            flat = np.concatenate(([loss], grad.ravel(), bend.ravel() if curved else []))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

        got = {r.i: r.v for r in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        flat = np.array([got[i] for i in range(size)])
        loss = float(flat[0] + 0.5 * (ridge * weights * weights).sum())
        grad = (flat[1 : 1 + weights.size].reshape(weights.shape) + ridge * weights).ravel()
        return (loss, grad, flat[1 + weights.size :].reshape(p + 1, p + 1) + np.diag(ridge)) if curved else (loss, grad)

    return evaluate


def logistic_regression(df: DataFrame, columns: Sequence[str], label: str, alpha: float = 0.0, max_iter: int = 200, g_tol: float = 1e-6) -> LogisticModel:
    """Minimum of the summed negative log-likelihood + alpha / 2 ||w||^2, the bias not penalised.

    Features are centred and scaled by their deviations while searching and scaled
    back. Two classes of up to NEWTON_COLUMNS columns are fitted by Newton's
    method, whose few steps each take one aggregation, all else by L-BFGS.
    """
    found = df.select(label).where(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    classes = tuple(sorted(r[0] for r in found))
    if len(classes) < 2:
        raise FitFailed(f"two classes are needed, the labels have {len(classes)}")
    if len(classes) > MAX_CLASSES:
        raise FitFailed(f"more than {MAX_CLASSES} classes")
    p, k = len(columns), len(classes)
    number = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(label)).cast("long") - 1
    stats = df.agg(*(f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop))).first()
    mean, sd = np.array(stats[0::2], float), np.array(stats[1::2], float)
    sd = np.where(sd > 0, sd, 1.0)
    x = [((F.col(c).cast("double") - float(m)) / float(s)).alias(f"x{i}") for i, (c, m, s) in enumerate(zip(columns, mean, sd, strict=True))]
    rows = materialise(df.where(F.col(label).isNotNull()).select(number.alias("y"), *x), "logistic")
    start = np.zeros((1 if k == 2 else k) * (p + 1))
    if k == 2 and p <= NEWTON_COLUMNS:
        found = newton(objective(rows, p, k, alpha, sd, True), start, max_iter=max_iter, g_tol=g_tol)
    else:
        found = lbfgs(objective(rows, p, k, alpha, sd), start, max_iter=max_iter, g_tol=g_tol)
    w = found.x.reshape(-1, p + 1)
    coef = w[:, :-1] / sd
    return LogisticModel(tuple(columns), classes, coef, w[:, -1] - coef @ mean, found.converged, found.iterations)
