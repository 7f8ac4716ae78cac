"""Lloyd's algorithm with distance bounds that are kept from step to step.

Rows lie in packed blocks with three more columns: the cluster of a row, an
upper bound of its distance from that centroid, and a lower bound of the
distance from all others. Centroids that have moved since the bounds were written
widen them by how far they moved, so a row whose bounds still tell is passed
over, and only the others meet all centroids. A step hands on the sums of rows
that are no longer in the cluster that was written; the blocks are written anew
when too few rows are decided. The centroids are those of the plain algorithm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.errors import FitFailed
from weftline.operators.cluster import KMeans, _blocks, _distances, _spread_seeds, _vectors
from weftline.session import materialise

#: Bounds are written anew when a smaller share of the rows than this is decided by them.
REWRITE = 0.5
_SLACK = 1e-12
_BLOCK = "v binary, a binary, u binary, l binary"


def _packed(v: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    kinds = ("<f8", "<i4", "<f8", "<f8")
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary()) for x, t in zip((v, a, u, low), kinds, strict=True)], names=["v", "a", "u", "l"])


def _read(batch: pa.RecordBatch, dims: int):
    for v, a, u, low in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
        yield np.frombuffer(v, "<f8").reshape(-1, dims), np.frombuffer(a, "<i4"), np.frombuffer(u, "<f8"), np.frombuffer(low, "<f8")


def _two_nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid, the lowest number among equals, its distance and that of the second."""
    d = np.sqrt(_distances(v, centres))
    near = d.argmin(1)
    every = np.arange(len(v))
    own = d[every, near]
    d[every, near] = np.inf
    return near, own, d.min(1)


@dataclass(frozen=True)
class _Widened:
    """How far bounds that were made for the centroids ``of`` reach for the centroids ``centres``."""

    centres: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @classmethod
    def since(cls, of: np.ndarray, centres: np.ndarray) -> _Widened:
        apart = np.sqrt(_distances(centres, centres))
        np.fill_diagonal(apart, np.inf)
        return cls(centres, np.linalg.norm(centres - of, axis=1), apart.min(1) / 2)

    def open_rows(self, a: np.ndarray, u: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The rows that the bounds do not decide; equal bounds decide nothing, so ties go as without bounds."""
        order = np.argsort(self.moved)
        most = np.where(a == order[-1], self.moved[order[-2]], self.moved[order[-1]])
        upper, lower = u + self.moved[a], np.maximum(low - most, self.half[a])
        return np.flatnonzero(~(upper * (1 + _SLACK) + _SLACK < lower))


@dataclass(frozen=True)
class Step:
    """One step: how many rows the bounds decided, and whether the bounds were written anew before it."""

    decided: int
    rows: int
    rewritten: bool


def kmeans_bounded(df: DataFrame, k: int = 2, max_iter: int = 100, features: str = "features", seed: int = 0, init: KMeans | None = None) -> tuple[KMeans, list[Step]]:
    """(model, steps): Lloyd's algorithm until no row changes its cluster.

    Rows without a vector are left out. The model's distortion follows from the
    sums and is rounded as their differences are.
    """
    if k < 2 or max_iter < 1:
        raise FitFailed(f"two clusters and one step are the least, not {k} and {max_iter}")
    rows = materialise(_vectors(df, features), "points")
    start = init or _spread_seeds(rows, k, seed)
    of = np.array(start.centroids, float)
    k, dims = of.shape

    def first(batches, of=of):
        for v in _blocks(batches, dims):
            yield _packed(v, *_two_nearest(v, of))

    table = materialise(rows.mapInArrow(first, _BLOCK), "bounded-points")

    def summed(change) -> np.ndarray:
        """The sums of what ``change`` makes of each block, k lines of (rows, squares, components)."""

        def run(batches):
            out = np.zeros((k + 1, dims + 2))
            for b in batches:
                for block in _read(b, dims):
                    change(out, *block)
            at = np.flatnonzero(out.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel()[at])], names=["i", "s"])

        total = np.zeros((k + 1) * (dims + 2))
        for r in table.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
            total[r.i] = r.s
        return total.reshape(k + 1, -1)

    def add(out: np.ndarray, v: np.ndarray, a: np.ndarray, sign: float) -> None:
        np.add.at(out, (a, 0), sign)
        np.add.at(out, (a, 1), sign * (v**2).sum(1))
        np.add.at(out, (a, slice(2, None)), sign * v)

    def whole(out, v, a, u, low):
        add(out, v, a, 1.0)

    written = now = summed(whole)
    if not written[:k, 0].sum():
        raise FitFailed("there are no rows")
    centres, steps, n = of, [Step(0, int(written[:k, 0].sum()), True)], 1

    def moved(total: np.ndarray, centres: np.ndarray) -> np.ndarray:
        full = total[:k, 0] > 0
        return np.where(full[:, None], total[:k, 2:] / np.where(full, total[:k, 0], 1)[:, None], centres)

    while n < max_iter:
        new = moved(now, centres)
        if np.array_equal(new, centres):
            break
        centres, n = new, n + 1
        wide = _Widened.since(of, centres)

        def changed(out, v, a, u, low, wide=wide):
            open_ = wide.open_rows(a, u, low)
            out[k, 0] += len(v) - len(open_)
            if len(open_):
                near = _distances(v[open_], wide.centres).argmin(1)
                other = near != a[open_]
                add(out, v[open_][other], a[open_][other], -1.0)
                add(out, v[open_][other], near[other], 1.0)

        delta = summed(changed)
        decided, total = int(delta[k, 0]), int(written[:k, 0].sum())
        now = written + np.vstack((delta[:k], np.zeros((1, dims + 2))))
        rewrite = decided < REWRITE * total
        steps.append(Step(decided, total, rewrite))
        if rewrite:

            def tightened(batches, wide=wide):
                for b in batches:
                    for v, a, u, low in _read(b, dims):
                        order = np.argsort(wide.moved)
                        most = np.where(a == order[-1], wide.moved[order[-2]], wide.moved[order[-1]])
                        a, u, low = a.copy(), u + wide.moved[a], low - most
                        open_ = wide.open_rows(a, u - wide.moved[a], low + most)
                        if len(open_):
                            a[open_], u[open_], low[open_] = _two_nearest(v[open_], wide.centres)
                        yield _packed(v, a, u, low)

            table, of = materialise(table.mapInArrow(tightened, _BLOCK), "bounded-points"), centres
            written = now = summed(whole)
    sizes = now[:k, 0]
    square = (centres**2).sum(1)
    distortion = float(now[:k, 1].sum() - (2 * centres * now[:k, 2:]).sum() + (sizes * square).sum())
    final = np.array_equal(moved(now, centres), centres)
    return KMeans(tuple(map(tuple, centres.tolist())), tuple(int(s) for s in sizes), max(distortion, 0.0), n, final), steps

