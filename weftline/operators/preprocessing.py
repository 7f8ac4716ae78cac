"""Scaling and categorical encoding, as column expressions over fitted values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from weftline.errors import FitFailed, TransformFailed
from weftline.frame import small
from weftline.functions.scalar import is_categorical

#: Deviations below it count as this, so a constant column becomes zeros.
LEAST_STD = 2.2250738585072014e-308
#: Categories that one column may have; the map is carried in the plan.
MAX_CATEGORIES = 65_536


@dataclass(frozen=True)
class StandardScaler:
    """(x - mean) / population deviation of each column."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    with_mean: bool = True
    with_std: bool = True

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str], with_mean: bool = True, with_std: bool = True) -> StandardScaler:
        row = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}__{i}") for c in columns for i, f in enumerate((F.avg, F.stddev_pop)))).first()
        if any(v is None for v in row):
            raise FitFailed("a column has no values")
        return StandardScaler(tuple(columns), tuple(row[0::2]), tuple(row[1::2]), with_mean, with_std)

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise TransformFailed(f"columns are missing: {missing}")
        out = {}
        for c, m, s in zip(self.columns, self.mean, self.std, strict=True):
            x = F.col(c).cast("double")
            x = x - m if self.with_mean else x
            out[c] = x / max(s, LEAST_STD) if self.with_std else x
        return df.withColumns(out)


@dataclass(frozen=True)
class CategoryMapper:
    """A bijection of categories and numbers from 0, in the order in which they are first seen."""

    categories: tuple

    @staticmethod
    def fit(df: DataFrame, column: str, order: str) -> CategoryMapper:
        first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("o"))
        rows = first.orderBy("o", column).limit(MAX_CATEGORIES + 1).collect()
        if len(rows) > MAX_CATEGORIES:
            raise FitFailed(f"more than {MAX_CATEGORIES} categories")
        return CategoryMapper(tuple(r[0] for r in rows))

    def __len__(self) -> int:
        return len(self.categories)

    def get_num(self, category) -> int | None:
        return self.categories.index(category) if category in self.categories else None

    def get_cat(self, num: int):
        return self.categories[num]

    def get_one_hot(self, category) -> list[float] | None:
        num = self.get_num(category)
        return None if num is None else [float(i == num) for i in range(len(self))]

    def invert_one_hot(self, vector: Sequence[float]):
        if sorted(vector) != [0.0] * (len(vector) - 1) + [1.0]:
            raise TransformFailed("a one-hot vector has exactly one 1")
        return self.categories[list(vector).index(1.0)]

    def number(self, value: Column, unseen_is_error: bool = False) -> Column:
        """The category's number; null, or an error, for one that was not seen."""
        place = F.array_position(F.array(*(F.lit(c) for c in self.categories)), value).cast("int") - 1
        found = F.when(place >= 0, place)
        return F.coalesce(found, F.raise_error(F.lit("unseen category")).cast("int")) if unseen_is_error else found

    def one_hot(self, value: Column, unseen_is_error: bool = False) -> Column:
        num = self.number(value, unseen_is_error)
        return F.transform(F.sequence(F.lit(0), F.lit(len(self) - 1)), lambda i: F.coalesce((i == num).cast("double"), F.lit(0.0)))

    def join(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the number of each row's category, null if unseen, by a join; for many categories."""
        kind = df.schema[column].dataType
        known = df.sparkSession.createDataFrame(list(enumerate(self.categories)), T.StructType([T.StructField(name, T.IntegerType()), T.StructField(column, kind)]))
        return df.join(small(known), column, "left")


@dataclass(frozen=True)
class OneHotEncoder:
    """Expands whole-number columns in place, a column for each category seen; none is dropped."""

    columns: tuple[str, ...]
    mappers: tuple[CategoryMapper, ...]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str], order: str) -> OneHotEncoder:
        checks = [F.max((~is_categorical(F.col(c).cast("double"))).cast("int")).alias(c) for c in columns]
        row = df.agg(*checks).first()
        odd = [c for c in columns if row[c]]
        if odd:
            raise FitFailed(f"columns are not categorical: {odd}")
        whole = df.select(order, *(F.round(c).cast("int").alias(c) for c in columns if c != order))
        return OneHotEncoder(tuple(columns), tuple(CategoryMapper.fit(whole, c, order) for c in columns))

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c not in self.columns:
                out.append(F.col(c))
                continue
            mapper = self.mappers[self.columns.index(c)]
            num = mapper.number(F.round(F.col(c).cast("double")).cast("int"), unseen_is_error=True)
            out += [F.when(num == i, 1.0).otherwise(0.0).alias(f"{c}_{v}") for i, v in enumerate(mapper.categories)]
        return df.select(*out)
