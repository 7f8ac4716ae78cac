"""Support vector machines over all rows with their duals, and a gap as the proof.

A kernel's machine goes by working sets (``operators/svm_rounds.py``). With the linear
kernel the weights are few, and the machine goes by the augmented Lagrangian of its
primal: each row has a dual, which stays beside it. A round minimises the loss rounded
around the duals, a smooth function of the weights and the bias, by Newton steps,
and then moves each dual to where the minimum puts it. A step is one aggregation
of a gradient and a matrix with a side for each weight, so neither its cost for a
row nor the number of rounds depends on how rows are dealt to tasks.

A row's share of the gap is what its loss, its dual and its value together lack
of being optimal. It is never negative; with no gap and a sum of zero the machine
is the optimum. Rounds end when the gap is ``tol`` of the objective.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.errors import FitFailed
from weftline.functions.kernels import Linear
from weftline.operators import svm_rounds
from weftline.operators.svm import HELD_VALUES, SupportTable, SupportVectors
from weftline.session import discard, materialise

#: Rows of a block, and of a task.
BLOCK_ROWS, TASK_ROWS = 2048, 16_384
#: Newton steps of a round, and halvings of a step.
NEWTON, HALVINGS = 30, 12
#: Components up to which the linear kernel's machine goes by its weights.
WEIGHTS = 1024
#: Parts of a sum that come to one place.
FAN_IN = 32
#: Growth of the penalty from round to round.
GROWTH = 3.0
_BLOCK = "ids binary, v binary, y binary, b binary"


@dataclass(frozen=True)
class DualMachine:
    """The machine, its duals (id, y, dual), and for each round the gap as a share of the objective and the duals' sum."""

    machine: SupportVectors | SupportTable
    duals: DataFrame = field(repr=False)
    rounds: list[tuple[float, float]]

    @property
    def gap(self) -> float:
        return self.rounds[-1][0]


def _row(ids, v, y, b) -> pa.RecordBatch:
    binary = [pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary()) for x, t in zip((ids, v, y, b), ("<i8", "<f8", "<f8", "<f8"), strict=True)]
    return pa.RecordBatch.from_arrays(binary, names=["ids", "v", "y", "b"])


def _blocks(batches, dims: int):
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for ids, v, y, b in zip(cols["ids"], cols["v"], cols["y"], cols["b"], strict=True):
            yield np.frombuffer(ids, "<i8"), np.frombuffer(v, "<f8").reshape(-1, dims), np.frombuffer(y, "<f8"), np.frombuffer(b, "<f8").copy()


def row_gaps(t: np.ndarray, y: np.ndarray, b: np.ndarray, c: float, eps: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(gap, loss) of rows with the values t and the duals b; ``eps`` is None for classes."""
    loss = c * (np.maximum(0, 1 - y * t) if eps is None else np.maximum(0, np.abs(t - y) - eps))
    return loss + (0 if eps is None else eps) * np.abs(b) - b * y + b * t, loss


def placed(t: np.ndarray, y: np.ndarray, b: np.ndarray, sigma: float, c: float, eps: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(duals, inside): where the values t draw the duals b by the penalty sigma, and which of them move along with t."""
    z = b + sigma * (y - t)
    if eps:
        z = np.sign(z) * np.maximum(np.abs(z) - sigma * eps, 0.0)
    low, high = (np.where(y > 0, 0.0, -c), np.where(y > 0, c, 0.0)) if eps is None else (-c, c)
    new = np.clip(z, low, high)
    return new, (new == z) & ((z != 0) | (not eps))


def fit(df: DataFrame, features: str, y: str, kernel, id_col: str, c: float = 1.0, eps: float | None = None, tol: float = 1e-3, max_rounds: int | None = None) -> DualMachine:
    """A two-class machine of labels -1 and 1, or with ``eps`` a regression with a band of that half width.

    Rows with a null are left out; equal rows have duals of their own. Without
    the gap asked after ``max_rounds`` rounds there is an error; if none are
    given, there are as many as the rows may need.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(features).cast("array<double>").alias("v"), F.col(y).cast("double").alias("y"))
    rows = materialise(rows.where("id is not null and v is not null and y is not null"), "machine")
    if eps is None and {r.y for r in rows.select("y").distinct().limit(3).collect()} != {-1.0, 1.0}:
        raise FitFailed("the two classes are told by -1 and 1, and both must occur")
    return machine(rows, kernel, c, eps, tol, max_rounds)


def machine(rows: DataFrame, kernel, c: float, eps: float | None, tol: float, max_rounds: int | None = None, proved: bool = True) -> DualMachine:
    """The machine of rows (id, v, y) without nulls; ``proved`` as for ``svm_rounds.fit``."""
    if c <= 0 or tol <= 0 or max_rounds is not None and max_rounds < 1:
        raise FitFailed(f"c, tol and max_rounds must be positive, got {c}, {tol} and {max_rounds}")
    first = rows.select(F.size("v")).first()
    if first is None:
        raise FitFailed("there are no rows")
    if isinstance(kernel, Linear) and first[0] <= WEIGHTS:
        return _by_weights(rows, kernel, first[0], c, eps, tol, max_rounds or 200)
    table, bias, history = svm_rounds.fit(rows, kernel, c, eps, tol, max_rounds, proved)
    marks = svm_rounds.support(table)
    number, dims = marks.count(), first[0]
    if number * dims > HELD_VALUES:
        found = SupportTable(kernel, marks, number, dims, bias)
    else:
        held = sorted(marks.collect(), key=lambda r: r.at)
        found = SupportVectors(kernel, np.array([r.v for r in held]).reshape(-1, dims), np.array([r.weight for r in held]), bias)
    return DualMachine(found, svm_rounds.told(table), history)


def _by_weights(rows: DataFrame, kernel, m: int, c: float, eps: float | None, tol: float, max_rounds: int) -> DualMachine:
    if rows.where(F.size("v") != m).limit(1).count():
        raise FitFailed("vectors differ in length")

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                n = part.num_rows
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                yield _row(part.column(0).to_numpy(), v, part.column(2).to_numpy(), np.zeros(n))

    number = rows.count()
    spread = rows.repartition(max(1, -(-number // TASK_ROWS)))
    table = materialise(spread.mapInArrow(pack, _BLOCK), "duals")
    size, tasks = m + 1, table.rdd.getNumPartitions()
    w = np.zeros(size)

    def summed(f, n: int) -> np.ndarray:
        """Sums over all rows of the n numbers that ``f`` makes of mapped rows, targets and duals."""

        def run(batches):
            out = np.zeros(n)
            for _, x, y, b in _blocks(batches, m):
                out += f(x, y, b)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["s"])

        def add(batches):
            out = np.zeros(n)
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    out += np.frombuffer(s, "<f8")
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["s"])

        parts = table.mapInArrow(run, "s binary")
        if tasks > FAN_IN:
            parts = parts.repartition(-(-tasks // FAN_IN)).mapInArrow(add, "s binary")
        return sum((np.frombuffer(r.s, "<f8") for r in parts.collect()), np.zeros(n))

    # A dual may cross its whole range where a row's value is off by one.
    sigma = c
    history: list[tuple[float, float]] = []
    for _ in range(max_rounds):
        anchor, hold = w[m], 1e-6 * sigma * number

        def total(w, slope_too: bool, sigma=sigma, anchor=anchor, hold=hold):
            def part(x, y, b):
                t = x @ w[:m] + w[m]
                new, inside = placed(t, y, b, sigma, c, eps)
                value = (new * (y - t) - (eps or 0.0) * np.abs(new) - (new - b) ** 2 / (2 * sigma)).sum()
                if not slope_too:
                    return np.array([value])
                z = x[inside]
                h = np.empty((size, size))
                h[:m, :m] = z.T @ z
                h[:m, m] = h[m, :m] = z.sum(0)
                h[m, m] = len(z)
                return np.concatenate(([value], -(new @ x), [-new.sum()], h.ravel()))

            s = summed(part, 1 + (size + size * size if slope_too else 0))
            value = s[0] + 0.5 * w[:m] @ w[:m] + 0.5 * hold * (w[m] - anchor) ** 2
            if not slope_too:
                return value, None, None
            regular = np.append(np.ones(m), hold)
            slope = s[1 : 1 + size] + regular * (w - np.append(np.zeros(m), anchor))
            return value, slope, sigma * s[1 + size :].reshape(size, size) + np.diag(regular)

        value, slope, curve = total(w, True)
        for _ in range(NEWTON):
            step = -np.linalg.solve(curve, slope)
            falls = -slope @ step
            if falls <= 1e-6 * tol * max(1.0, abs(value)):
                break
            for _ in range(HALVINGS):
                new = total(w + step, True)
                if new[0] <= value - 1e-4 * falls:
                    break
                step, falls = step / 2, falls / 2
            else:
                break
            w = w + step
            value, slope, curve = new

        def moved(batches, w=w, sigma=sigma):
            for ids, x, y, b in _blocks(batches, m):
                yield _row(ids, x, y, placed(x @ w[:m] + w[m], y, b, sigma, c, eps)[0])

        last, table = table, materialise(table.mapInArrow(moved, _BLOCK), "duals")
        discard(last)
        # The weights that are told are those of the duals themselves.
        duals = summed(lambda x, y, b: np.append(b @ x, b.sum()), size)
        told_w, bias = duals[:m], w[m]

        def lacks(x, y, b, told_w=told_w, bias=bias):
            gap, loss = row_gaps(x @ told_w + bias, y, b, c, eps)
            return np.array([gap.sum(), loss.sum()])

        gap, loss = summed(lacks, 2)
        history.append((float(gap / max(1.0, 0.5 * told_w @ told_w + loss)), float(duals[m] / c)))
        if history[-1][0] <= tol and abs(history[-1][1]) <= max(1.0, abs(loss)) * tol:
            break
        sigma *= GROWTH
    else:
        raise FitFailed(f"the gap is {history[-1][0]:.3g} of the objective after {max_rounds} rounds")

    def told(batches):
        for ids, _, y, b in _blocks(batches, m):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(y), pa.array(b)], names=["id", "y", "dual"])

    duals = table.mapInArrow(told, "id long, y double, dual double")
    return DualMachine(SupportVectors(kernel, told_w[None, :], np.ones(1), float(bias)), duals, history)
