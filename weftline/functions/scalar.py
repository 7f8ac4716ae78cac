"""Numeric functions of one value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ln_1pe(x: Column) -> Column:
    """ln(1 + exp(x)); x itself above 15."""
    return F.when(x > 15, x).otherwise(F.log1p(F.exp(F.least(x, F.lit(15.0)))))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), 0 below -40 and 1 above 40."""
    inside = 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))))
    return F.when(x < -40, 0.0).when(x > 40, 1.0).otherwise(inside)


def square(x: Column) -> Column:
    return x * x


def copysign(x: Column, sign: Column) -> Column:
    """The magnitude of ``x`` with the sign of ``sign`` (a zero counts as positive)."""
    return F.when(sign < 0, -F.abs(x)).otherwise(F.abs(x))


def binarize(x: Column, threshold: float) -> Column:
    """1 above the threshold, else 0; the threshold itself is 0."""
    return F.when(x > threshold, 1.0).otherwise(0.0)


def is_categorical(x: Column) -> Column:
    """True if a value is within 0.001 of a whole number from 0 to 65535."""
    return (F.abs(x - F.round(x)) < 0.001) & (F.round(x) >= 0) & (F.round(x) <= 65535)
