"""Shapes of observations and conversions between them.

Wide:   one double column a feature.  Packed: one ``array<double>`` column.
Long:   (id, j, value), one row a cell.  All numeric types are read as double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weftline.errors import ParametersError

#: Rows of a side that is broadcast at most; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 100_000


def doubles(cols: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double").alias(c) for c in cols]


def pack(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    """Wide to packed; the other columns stay."""
    return df.withColumn(name, F.array(*(F.col(c).cast("double") for c in cols)))


def unpack(df: DataFrame, n: int, name: str = "features", prefix: str = "f") -> DataFrame:
    """Packed to wide with columns ``f0 .. f{n-1}``."""
    return df.select("*", *(F.col(name)[j].alias(f"{prefix}{j}") for j in range(n))).drop(name)


def cells(df: DataFrame, id_col: str, features: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """Packed to long: (id, kept columns, j, value)."""
    return df.select(id_col, *keep, F.posexplode(F.col(features).cast("array<double>")).alias("j", "value"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows stay within the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def check_same_rows(n_x: int, n_y: int) -> None:
    if n_x != n_y:
        raise ParametersError(f"{n_x} rows of features do not go with {n_y} targets")
