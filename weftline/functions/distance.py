"""Distances between two packed vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

from weftline.errors import ParametersError
from weftline.functions.vectors import total

Distance = Callable[[Column, Column], Column]


def metric(distance: Distance) -> Distance:
    """Mark a distance that keeps to the triangle inequality, so that searches may leave rows out by it."""
    distance.metric = True
    return distance


def is_metric(distance: Distance) -> bool:
    return getattr(distance, "metric", False)


#: Pairs whose values are worked on at once, so that they stay in a core's cache.
PAIRS_AT_ONCE = 1 << 15


def sliced(n: int, width: int):
    """Ranges of n rows that make about ``PAIRS_AT_ONCE`` pairs with ``width`` others each."""
    step = max(1, PAIRS_AT_ONCE // max(1, width))
    return [(lo, min(lo + step, n)) for lo in range(0, n, step)]


def _sums(a: np.ndarray, b: np.ndarray, term: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sums over components of what ``term`` makes, in place, of the differences of all rows of a and b.

    Components are added in their order, as the column forms do.
    """
    out = np.zeros((len(a), len(b)))
    across = np.ascontiguousarray(b.T)
    for lo, hi in sliced(len(a), len(b)):
        z, total = np.empty((hi - lo, len(b))), out[lo:hi]
        for x, y in zip(a[lo:hi].T, across, strict=True):
            np.subtract(x[:, None], y, out=z)
            total += term(z)
    return out


def by_matrix(matrix: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Give a distance the form that compares all rows of two arrays, for tasks."""

    def add(distance: Distance) -> Distance:
        distance.matrix = matrix
        return distance

    return add


def squared_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _sums(a, b, lambda z: np.multiply(z, z, out=z))


def _checked(a: Column, b: Column, value: Column) -> Column:
    same = F.size(a) == F.size(b)
    return F.when(same, value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def squared_euclidian(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


@by_matrix(lambda a, b: np.sqrt(squared_matrix(a, b)))
@metric
def euclidian(a: Column, b: Column) -> Column:
    return _checked(a, b, F.sqrt(squared_euclidian(a, b)))


@by_matrix(lambda a, b: _sums(a, b, lambda z: np.abs(z, out=z)))
@metric
def manhattan(a: Column, b: Column) -> Column:
    return _checked(a, b, total(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def minkowski(p: int) -> Distance:
    if p < 1:
        raise ParametersError("p must be at least 1")

    def power(z: np.ndarray) -> np.ndarray:
        np.abs(z, out=z)
        if p not in (2, 3, 4):
            return np.power(z, p, out=z)
        once = z.copy()
        for _ in range(p - 1):
            z *= once
        return z

    add = by_matrix(lambda a, b: _sums(a, b, power) ** (1.0 / p))
    return add(metric(lambda a, b: _checked(a, b, F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p)))))


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Two NaN are equal, as in Spark.
    out, dims = np.zeros((len(a), len(b))), max(a.shape[1], 1)
    across = np.ascontiguousarray(b.T)
    for lo, hi in sliced(len(a), len(b)):
        for x, y in zip(a[lo:hi].T, across, strict=True):
            out[lo:hi] += (x[:, None] != y) & ~(np.isnan(x)[:, None] & np.isnan(y))
    return out / dims


@by_matrix(_differing)
@metric
def hamming(a: Column, b: Column) -> Column:
    """Share of places that differ."""
    return _checked(a, b, total(F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))) / F.size(a))


def mahalanobis(covariance: np.ndarray) -> Distance:
    """sqrt(z' C^-1 z) for a known covariance; a singular one is an error."""
    try:
        inverse = np.linalg.inv(np.asarray(covariance, float))
    except np.linalg.LinAlgError as e:
        raise ParametersError("the covariance is singular") from e

    def distance(a: Column, b: Column) -> Column:
        z = F.zip_with(a, b, lambda x, y: x - y)
        rows = F.array(*(total(F.zip_with(z, F.lit(r.tolist()), lambda x, y: x * y)) for r in inverse))
        return _checked(a, b, F.sqrt(total(F.zip_with(z, rows, lambda x, y: x * y))))

    return metric(distance)


DISTANCES: dict[str, Callable[..., Distance] | Distance] = {
    "euclidian": euclidian,
    "manhattan": manhattan,
    "minkowski": minkowski,
    "hamming": hamming,
    "mahalanobis": mahalanobis,
}
