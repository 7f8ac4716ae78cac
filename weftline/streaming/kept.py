"""Models that a stream keeps up to date.

Each batch adds its sums to those of the batch before and writes the total under
its own number, so a batch that is run again replaces what it wrote and nothing
is counted twice. A total is a few numbers whatever the stream has seen; the
newest ones are kept, and a model is solved from the newest at any time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.errors import FitFailed
from weftline.operators.linear import LinearModel

#: Totals that are kept besides the newest.
KEPT = 3


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the totals that are there, in order."""
    where, files = _path(spark, path)
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    found = [int(m[1]) for n in names if (m := re.fullmatch(r"total-(\d+)", n))]
    return sorted(b for b in found if files.exists(_path(spark, f"{path}/total-{b}/_SUCCESS")[0]))


def total(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The total of a batch, by default of the newest."""
    known = batches(spark, path)
    if not known or batch is not None and batch not in known:
        raise FitFailed("the stream has written no such total")
    return spark.read.parquet(f"{path}/total-{known[-1] if batch is None else batch}")


def add_batch(path: str, sums: Callable[[DataFrame], DataFrame], keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: ``sums`` makes of a batch a few rows whose other columns than ``keys`` add up."""

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        before = [b for b in batches(spark, path) if b < batch]
        own = sums(df)
        values = [c for c in own.columns if c not in keys]
        if before:
            own = own.unionByName(total(spark, path, before[-1])).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in values))
        own.coalesce(1).write.mode("overwrite").parquet(f"{path}/total-{batch}")
        for old in before[: -KEPT or None]:
            where, files = _path(spark, f"{path}/total-{old}")
            files.delete(where, True)

    return run


def cross_sums(columns: Sequence[str], y: str) -> Callable[[DataFrame], DataFrame]:
    """(i, j, v): counts, sums and products of 1, the columns and the target, without rows that lack any."""
    names = [*columns, y]

    def run(df: DataFrame) -> DataFrame:
        x = [F.lit(1.0), *(F.col(c).cast("double") for c in names)]
        pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
        rows = df.where(" and ".join(f"`{c}` is not null" for c in names))
        wide = rows.agg(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.coalesce(F.sum(x[i] * x[j]), F.lit(0.0)).alias("v")) for i, j in pairs)).alias("s"))
        return wide.select(F.inline("s"))

    return run


@dataclass(frozen=True)
class KeptLinear:
    """Least squares, or ridge with ``alpha``, over all that a stream has brought."""

    path: str
    columns: tuple[str, ...]
    y: str
    alpha: float = 0.0

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """The running query; the checkpoint makes batches numbered as before after a restart."""
        run = add_batch(self.path, cross_sums(self.columns, self.y), ["i", "j"])
        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def model(self, spark: SparkSession) -> LinearModel:
        p = len(self.columns)
        s = np.zeros((p + 2, p + 2))
        for r in total(spark, self.path).collect():
            s[r.i, r.j] = s[r.j, r.i] = r.v
        if not s[0, 0]:
            raise FitFailed("the stream has brought no whole rows")
        mean = s[0, 1:] / s[0, 0]
        c = s[1:, 1:] - s[0, 0] * np.outer(mean, mean)
        w = np.linalg.lstsq(c[:p, :p] + self.alpha * np.eye(p), c[:p, p], rcond=1e-12)[0]
        return LinearModel(self.columns, tuple(w.tolist()), float(mean[p] - mean[:p] @ w))


def class_sums(label: str, features: str = "features") -> Callable[[DataFrame], DataFrame]:
    """(label, j, n, s, q): counts, sums and squares of each component for each class."""

    def run(df: DataFrame) -> DataFrame:
        cells = df.select(F.col(label).alias("label"), F.posexplode(F.col(features).cast("array<double>")).alias("j", "v")).where("label is not null and v is not null")
        return cells.groupBy("label", "j").agg(F.count("v").cast("double").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))

    return run


@dataclass(frozen=True)
class KeptClasses:
    """Means and variances of each class, the statistics of a Gaussian naive Bayes model."""

    path: str
    label: str
    features: str = "features"

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        run = add_batch(self.path, class_sums(self.label, self.features), ["label", "j"])
        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def stats(self, spark: SparkSession) -> DataFrame:
        """(label, j, n, theta, var); the variance is of the population."""
        mean = F.col("s") / F.col("n")
        return total(spark, self.path).select("label", "j", F.col("n").cast("long").alias("n"), mean.alias("theta"), F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean).alias("var"))

