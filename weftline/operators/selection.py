"""Splits, folds, cross-validation and parameter grids."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.errors import ParametersError
from weftline.session import materialise


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "row") -> DataFrame:
    """``df`` with row numbers from 0 in an order, by ranges and their counts rather than in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    keyed = df.withColumns({f"__o{i}": k for i, k in enumerate(keys)})
    names = [f"__o{i}" for i in range(len(keys))]
    ranged = materialise(keyed.repartitionByRange(parts, *names).withColumn("__p", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    first = counts.select("__p", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    at = F.col("__first") + F.row_number().over(Window.partitionBy("__p").orderBy(*names)) - 1
    return ranged.join(F.broadcast(first), "__p").withColumn(name, at.cast("long")).drop("__p", "__first", *names)


def _order(id_col: str, shuffle: bool, seed: int) -> list[Column]:
    return [F.xxhash64(id_col, F.lit(seed)), F.col(id_col)] if shuffle else [F.col(id_col)]


def train_test_split(df: DataFrame, id_col: str, test_size: float, shuffle: bool = True, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): the first floor(n * test_size) rows are the test set; the product is in single precision."""
    if not 0 < test_size <= 1:
        raise ParametersError(f"a test share of {test_size} is not between 0 and 1")
    n_test = int(np.float32(df.count()) * np.float32(test_size))
    if n_test < 1:
        raise ParametersError("the test share leaves no test row")
    rows = numbered(df, _order(id_col, shuffle, seed), "__row")
    return rows.where(F.col("__row") >= n_test).drop("__row"), rows.where(F.col("__row") < n_test).drop("__row")


def k_fold(df: DataFrame, id_col: str, n_splits: int = 3, shuffle: bool = True, seed: int = 0, name: str = "fold") -> DataFrame:
    """``df`` with a fold number; folds are runs of rows, the first n % k of them a row longer."""
    if n_splits < 2:
        raise ParametersError(f"{n_splits} folds leave nothing to train on")
    n = df.count()
    size, more = divmod(n, n_splits)
    row = F.col("__row")
    long = more * (size + 1)
    fold = F.when(row < long, F.floor(row / (size + 1))).otherwise(more + F.floor((row - long) / max(size, 1)))
    return numbered(df, _order(id_col, shuffle, seed), "__row").withColumn(name, fold.cast("int")).drop("__row")


@dataclass(frozen=True)
class CrossValidationResult:
    test_score: tuple[float, ...]
    train_score: tuple[float, ...]

    def mean_test_score(self) -> float:
        return sum(self.test_score) / len(self.test_score)

    def mean_train_score(self) -> float:
        return sum(self.train_score) / len(self.train_score)


def cross_validate(df: DataFrame, id_col: str, fit: Callable[[DataFrame], object], score: Callable[[DataFrame], float], n_splits: int = 3, shuffle: bool = True, seed: int = 0) -> CrossValidationResult:
    """Fits on all folds but one; ``score`` gets predicted rows. ``fit`` returns a model with ``predict``."""
    folds = materialise(k_fold(df, id_col, n_splits, shuffle, seed, "__fold"), "folds")
    test, train = [], []
    for i in range(n_splits):
        inside, outside = (folds.where(c).drop("__fold") for c in (F.col("__fold") != i, F.col("__fold") == i))
        model = fit(inside)
        test.append(float(score(model.predict(outside))))
        train.append(float(score(model.predict(inside))))
    return CrossValidationResult(tuple(test), tuple(train))


def cross_val_predict(df: DataFrame, id_col: str, fit: Callable[[DataFrame], object], n_splits: int = 3, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """Every row once, with the prediction of the model that has not seen it."""
    folds = materialise(k_fold(df, id_col, n_splits, shuffle, seed, "__fold"), "folds")
    parts = [fit(folds.where(F.col("__fold") != i).drop("__fold")).predict(folds.where(F.col("__fold") == i).drop("__fold")) for i in range(n_splits)]
    return reduce(DataFrame.unionByName, parts)


def param_grid(**lists: Sequence) -> Iterator[dict]:
    """All combinations of the lists' values; the first parameter varies fastest."""
    names = list(lists)
    for values in product(*(lists[n] for n in reversed(names))):
        yield dict(zip(names, reversed(values), strict=True))


@dataclass(frozen=True)
class GridSearchResult:
    best_params: dict
    best_score: float
    model: object
    scores: tuple[tuple[dict, float], ...]


def grid_search(df: DataFrame, id_col: str, fit: Callable[..., object], score: Callable[[DataFrame], float], grid: dict[str, Sequence], **cv) -> GridSearchResult:
    """The parameters of the highest mean test score, the first among equals, refitted on all rows."""
    scores = [(p, cross_validate(df, id_col, lambda d, p=p: fit(d, **p), score, **cv).mean_test_score()) for p in param_grid(**grid)]
    best, top = scores[0]
    for p, s in scores[1:]:
        if s > top:
            best, top = p, s
    return GridSearchResult(best, top, fit(df, **best), tuple(scores))
