"""Functions of ``array<double>`` columns: reductions, norms, arithmetic, softmax."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v).cast("double"))


def variance(v: Column) -> Column:
    """Population variance, from centred values."""
    centre = mean(v)
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre)), F.size(v).cast("double"))


def std_dev(v: Column) -> Column:
    return F.sqrt(variance(v))


def argmax(v: Column) -> Column:
    """Index of the first largest component."""
    return F.array_position(v, F.array_max(v)).cast("int") - 1


def argsort(v: Column) -> Column:
    """Indices in ascending order of value; ties keep their order."""
    pairs = F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column, p: float) -> Column:
    """The p-norm; plus and minus infinity give the largest and smallest magnitude."""
    size = F.transform(v, F.abs)
    if p == float("inf"):
        return F.array_max(size)
    if p == float("-inf"):
        return F.array_min(size)
    return F.pow(total(F.transform(size, lambda x: F.pow(x, F.lit(float(p))))), F.lit(1 / p))


def norm2(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def max_diff(a: Column, b: Column) -> Column:
    """Largest absolute difference of two vectors."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def approximate_eq(a: Column, b: Column, error: float) -> Column:
    """True if the lengths agree and no component differs by more than ``error``."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= error), lambda x: x)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def unique(v: Column) -> Column:
    return F.array_sort(F.array_distinct(v))


def unique_with_indices(v: Column) -> Column:
    """struct(values, indices): the sorted distinct values and each component's place among them."""
    values = unique(v)
    return F.struct(values.alias("values"), F.transform(v, lambda x: F.array_position(values, x).cast("int") - 1).alias("indices"))


def take(v: Column, index: list[int]) -> Column:
    """Components by index, in the order asked, repeats kept."""
    return F.array(*(v[i] for i in index))


def elementwise(a: Column, b: Column | float, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` on each component and its partner, or on each component and one number."""
    if isinstance(b, Column):
        return F.zip_with(a, b, op)
    return F.transform(a, lambda x: op(x, F.lit(float(b))))
