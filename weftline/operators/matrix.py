"""Matrices as tables of rows, and as long tables of cells (i, j, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.errors import ParametersError
from weftline.frame import small
from weftline.operators.selection import numbered


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n, sum, mean, min, max, var, std) of each column; variance and deviation are of the population.

    One aggregation over the rows; NaN counts neither as least nor as greatest.
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        seen = F.nanvl(x, F.lit(None).cast("double"))
        for name, a in (("n", F.count(x)), ("sum", F.sum(x)), ("mean", F.avg(x)), ("min", F.min(seen)), ("max", F.max(seen)), ("var", F.var_pop(x)), ("std", F.stddev_pop(x))):
            aggs.append(a.alias(f"{c}__{name}"))
    wide = df.agg(*aggs)
    names = ("n", "sum", "mean", "min", "max", "var", "std")
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{c}__{n}").alias(n) for n in names)) for c in cols))
    return wide.select(F.inline(rows))


def covariance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, cov): the sample covariance of each two columns."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*(F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs))
    both = pairs + [(b, a) for a, b in pairs if a != b]
    value = lambda a, b: F.col(f"{a}__{b}" if (a, b) in pairs else f"{b}__{a}")
    return wide.select(F.inline(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), value(a, b).alias("cov")) for a, b in both))))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def reshape(cells: DataFrame, columns: int, new_columns: int, rows: int | None = None) -> DataFrame:
    """Row-major reshape of a matrix with ``columns`` columns into ``new_columns``."""
    if rows is not None and rows * columns % new_columns:
        raise ParametersError(f"cannot reshape {rows}x{columns} into rows of {new_columns}")
    at = F.col("i") * columns + F.col("j")
    return cells.select(F.floor(at / new_columns).cast("long").alias("i"), (at % new_columns).cast("int").alias("j"), "value")


def diagonal(cells: DataFrame) -> DataFrame:
    return cells.where("i = j").select("i", "value")


def matmul(a: DataFrame, b: DataFrame, transpose_a: bool = False, transpose_b: bool = False) -> DataFrame:
    """The product of two long matrices: a join on the inner index and one partial aggregation."""
    a = transpose(a) if transpose_a else a
    b = transpose(b) if transpose_b else b
    left = a.select("i", F.col("j").alias("k"), F.col("value").alias("x"))
    right = small(b.select(F.col("i").alias("k"), "j", F.col("value").alias("y")))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def matvec(a: DataFrame, x: DataFrame, transpose_a: bool = False) -> DataFrame:
    """(i, value) of a long matrix times a vector (i, value)."""
    a = transpose(a) if transpose_a else a
    v = small(x.select(F.col("i").alias("j"), F.col("value").alias("y")))
    return a.join(v, "j").groupBy("i").agg(F.sum(F.col("value") * F.col("y")).alias("value"))


def take_rows(df: DataFrame, id_col: str, index: Sequence[int]) -> DataFrame:
    """Rows by identifier, in the order asked (column ``pos``), repeats kept."""
    asked = df.sparkSession.createDataFrame([(p, i) for p, i in enumerate(index)], "pos int, __id long")
    return small(asked).join(df, F.col("__id") == F.col(id_col)).drop("__id")


def take_columns(vectors: Column, index: Sequence[int]) -> Column:
    """The components of a packed row at some places, in the order asked, repeats kept."""
    return F.array(*(F.element_at(vectors, i + 1) for i in index))


def equal(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(equal, differing): whether two long matrices have the same cells, and how many have not.

    A cell that only one side has differs; NaN equals nothing.
    """
    x = a.select("i", "j", F.col("value").cast("double").alias("x"))
    y = b.select("i", "j", F.col("value").cast("double").alias("y"))
    same = (F.abs(F.col("x") - F.col("y")) <= tolerance) & ~F.isnan("x") & ~F.isnan("y")
    found = x.join(y, ["i", "j"], "full").agg(F.count(F.when(~F.coalesce(same, F.lit(False)), 1)).alias("differing"))
    return found.select((F.col("differing") == 0).alias("equal"), "differing")


def slice_rows(df: DataFrame, id_col: str, start: int, stop: int, cols: Sequence[str] | None = None) -> DataFrame:
    """The rectangle of rows start <= id < stop and some columns."""
    out = df.where((F.col(id_col) >= start) & (F.col(id_col) < stop))
    return out.select(id_col, *cols) if cols else out


def v_stack(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """``b`` under ``a``; its identifiers follow the largest of ``a``."""
    last = a.agg((F.max(id_col) + 1).alias("__n"))
    moved = b.crossJoin(F.broadcast(last)).withColumn(id_col, F.col(id_col) + F.coalesce("__n", F.lit(0))).drop("__n")
    return a.unionByName(moved)


def h_stack(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """Columns of ``b`` beside those of ``a``, rows matched by identifier."""
    return a.join(b, id_col)


def unique(df: DataFrame, col: str) -> DataFrame:
    """(value, idx): distinct values and their dense places in order, counted by ranges."""
    return numbered(df.select(F.col(col).alias("value")).distinct(), ["value"], "idx")


def norm(df: DataFrame, col: str, p: float = 2.0) -> DataFrame:
    """The p-norm of a column as one number."""
    x = F.abs(F.col(col).cast("double"))
    if p == float("inf"):
        return df.agg(F.max(x).alias("norm"))
    if p == float("-inf"):
        return df.agg(F.min(x).alias("norm"))
    return df.agg(F.pow(F.sum(F.pow(x, F.lit(p))), F.lit(1 / p)).alias("norm"))


def top_k(df: DataFrame, k: int, order: str, tie: str, group: Sequence[str] = ()) -> DataFrame:
    """The k smallest rows, of each group or of all; ties by ``tie``."""
    if not group:
        return df.orderBy(order, tie).limit(k)
    w = Window.partitionBy(*group).orderBy(order, tie)
    return df.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)
