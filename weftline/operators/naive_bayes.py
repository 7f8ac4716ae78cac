"""Naive Bayes models from one or two group-bys; scoring is an expression over a broadcast model.

A model is a pair of small tables: classes (label, n, prior) and cells of
per-class, per-feature statistics. Up to MODEL_CELLS cells they are broadcast as
one row, and each vector is scored where it is; larger models are joined on the
feature. Equal scores go to the later class, a score that is not a number counts
as the lowest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.errors import FitFailed, ParametersError
from weftline.frame import cells, small
from weftline.session import materialise


#: Cells of a model that is broadcast.
MODEL_CELLS = 200_000


def _classes(df: DataFrame, label: str, priors: Sequence[float] | None) -> DataFrame:
    """(label, n, prior) in label order; given priors go by that order."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if priors is None:
        total = df.agg(F.count(F.lit(1)).cast("double").alias("t"))
        return n.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("t")).alias("prior"))
    if n.count() != len(priors):
        raise FitFailed(f"{len(priors)} priors do not go with the classes of the labels")
    at = F.row_number().over(Window.orderBy("label"))
    return n.select("label", "n", F.element_at(F.array(*(F.lit(float(p)) for p in priors)), at).alias("prior"))


def _pick(scored: DataFrame, id_col: str) -> DataFrame:
    """(id, prediction) from (id, label, score)."""
    s = F.coalesce(F.nanvl("score", F.lit(float("-inf"))), F.lit(float("-inf")))
    return scored.groupBy(id_col).agg(F.max_by("label", F.struct(s.alias("s"), "label")).alias("prediction"))


def _gaussian_term(x: Column, c: Column) -> Column:
    d = x - c["theta"]
    return F.when(c["var"] > 0, -0.5 * (F.log(2 * F.pi() * c["var"]) + d * d / c["var"])).otherwise(F.when(c["var"].isNotNull(), F.lit(float("nan"))))


def _multinomial_term(x: Column, c: Column) -> Column:
    return x * c["feature_log_prob"]


def _bernoulli_term(x: Column, c: Column) -> Column:
    return F.when(x == 1, c["feature_log_prob"]).otherwise(c["absent_log_prob"])


#: What a value adds to a class's log-likelihood, from the statistics of its class and feature.
TERMS = {"gaussian": _gaussian_term, "multinomial": _multinomial_term, "bernoulli": _bernoulli_term}


@dataclass
class NaiveBayes:
    classes: DataFrame
    stats: DataFrame
    kind: str
    binarize: float | None = None
    _model: DataFrame = field(default=None, init=False, repr=False)

    def __post_init__(self):
        # The fitted tables are small and used by every prediction, so they are made once.
        self.classes, self.stats = materialise(self.classes, "nb-classes"), materialise(self.stats, "nb-stats")

    @property
    def n_features(self) -> int:
        return self.stats.select("j").distinct().count()

    def _value(self, x: Column) -> Column:
        return x if self.binarize is None else F.when(x > self.binarize, 1.0).otherwise(0.0)

    def _row(self) -> DataFrame | None:
        """The model as one row, if its counted cells are few enough."""
        if self._model is None and self.stats.count() <= MODEL_CELLS:
            cell = F.struct("j", *(c for c in self.stats.columns if c not in ("j", "label")))
            per = self.stats.groupBy("label").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
            prior = F.when(F.col("prior") > 0, F.log("prior")).otherwise(F.lit(float("-inf")))
            known = self.classes.join(per, "label").select(F.struct("label", prior.alias("prior"), "cells").alias("c"))
            self._model = materialise(known.agg(F.array_sort(F.collect_list("c")).alias("__model")), "nb-model")
        return self._model

    def scores(self, df: DataFrame, id_col: str, features: str = "features") -> DataFrame:
        """(id, label, score)."""
        term = TERMS[self.kind]
        if (row := self._row()) is not None:
            v = F.transform(F.col(features).cast("array<double>"), self._value)
            part = lambda m: F.aggregate(F.zip_with(v, m["cells"], lambda x, c: F.coalesce(term(x, c), F.lit(0.0))), F.lit(0.0), lambda a, t: a + t)
            each = F.transform("__model", lambda m: F.struct(m["label"].alias("label"), (part(m) + m["prior"]).alias("score")))
            return df.where(F.col(features).isNotNull()).join(F.broadcast(row), F.lit(True)).select(id_col, F.inline(each))
        long = cells(df, id_col, features).withColumn("value", self._value(F.col("value")))
        own = F.struct(*(c for c in self.stats.columns if c not in ("j", "label")))
        likely = long.join(self.stats, "j").groupBy(id_col, "label").agg(F.sum(term(F.col("value"), own)).alias("l"))
        prior = F.when(F.col("prior") > 0, F.log("prior")).otherwise(F.lit(float("-inf")))
        return likely.join(small(self.classes), "label").select(id_col, "label", (F.col("l") + prior).alias("score"))

    def predict(self, df: DataFrame, id_col: str, features: str = "features") -> DataFrame:
        """(id, prediction)."""
        return _pick(self.scores(df, id_col, features), id_col)


def _counts(df: DataFrame, label: str, features: str, value: Column) -> DataFrame:
    """(label, j, feature_count)."""
    long = df.select(F.col(label).alias("label"), F.posexplode(F.col(features).cast("array<double>")).alias("j", "value"))
    return long.groupBy("label", "j").agg(F.sum(value).alias("feature_count"))


def gaussian(df: DataFrame, label: str, features: str = "features", priors: Sequence[float] | None = None) -> NaiveBayes:
    """Normal likelihoods with the mean and population variance of each class and feature; no smoothing."""
    long = df.select(F.col(label).alias("label"), F.posexplode(F.col(features).cast("array<double>")).alias("j", "value"))
    stats = long.groupBy("label", "j").agg(F.avg("value").alias("theta"), F.var_pop("value").alias("var"))
    return NaiveBayes(_classes(df, label, priors), stats, "gaussian")


def _alpha(alpha: float) -> None:
    if alpha < 0:
        raise FitFailed(f"smoothing by {alpha} is negative")


def multinomial(df: DataFrame, label: str, features: str = "features", alpha: float = 1.0, priors: Sequence[float] | None = None) -> NaiveBayes:
    """Counts of occurrences, smoothed by alpha; the priors are not smoothed."""
    _alpha(alpha)
    n = _counts(df, label, features, F.col("value"))
    w = Window.partitionBy("label")
    p = (F.col("feature_count") + alpha) / (F.sum("feature_count").over(w) + alpha * F.count(F.lit(1)).over(w))
    stats = n.select("label", "j", "feature_count", F.log(p).alias("feature_log_prob"))
    return NaiveBayes(_classes(df, label, priors), stats, "multinomial")


def bernoulli(df: DataFrame, label: str, features: str = "features", alpha: float = 1.0, priors: Sequence[float] | None = None, binarize: float | None = 0.0) -> NaiveBayes:
    """Presence or absence of each feature, after the strict threshold ``binarize``."""
    _alpha(alpha)
    on = F.col("value") if binarize is None else F.when(F.col("value") > binarize, 1.0).otherwise(0.0)
    n = _counts(df, label, features, on)
    classes = _classes(df, label, priors)
    p = (F.col("feature_count") + alpha) / (F.col("n") + 2 * alpha)
    stats = n.join(small(classes), "label").select("label", "j", "feature_count", F.log(p).alias("feature_log_prob"), F.log(1 - p).alias("absent_log_prob"))
    return NaiveBayes(classes, stats, "bernoulli", binarize)


class CategoricalNB(NaiveBayes):
    """Category codes from 0; an unseen code makes the likelihood of the whole row 0 in logarithm."""

    def scores(self, df: DataFrame, id_col: str, features: str = "features") -> DataFrame:
        long = cells(df, id_col, features).withColumn("value", F.col("value").cast("int"))
        labels = small(self.classes.select("label", "prior"))
        seen = long.join(small(self.stats), ["j", "value"])
        likely = seen.groupBy(id_col, "label").agg(F.sum("feature_log_prob").alias("l"), F.count(F.lit(1)).alias("c"))
        width = df.select(id_col, F.size(features).alias("w"))
        every = width.join(labels, F.lit(True)).join(likely, [id_col, "label"], "left")
        l = F.when(F.col("c") == F.col("w"), F.col("l")).otherwise(0.0)
        prior = F.when(F.col("prior") > 0, F.log("prior")).otherwise(F.lit(float("-inf")))
        return every.select(id_col, "label", (l + prior).alias("score"))


def categorical(df: DataFrame, label: str, features: str = "features", alpha: float = 1.0) -> CategoricalNB:
    """Codes 0 .. the largest seen for each feature, classes 0 .. the largest label, gaps with prior 0."""
    _alpha(alpha)
    long = df.select(F.col(label).cast("int").alias("label"), F.posexplode(F.col(features).cast("array<double>")).alias("j", "value"))
    long = long.withColumn("value", F.col("value").cast("int"))
    if long.where("value < 0 or label < 0").limit(1).count():
        raise ParametersError("codes and labels must not be negative")
    seen = long.groupBy("label", "j", "value").agg(F.count(F.lit(1)).alias("category_count"))
    size = seen.groupBy("j").agg((F.max("value") + 1).alias("n_categories"))
    per = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    all_ = per.agg(F.max("label").alias("m"), F.sum("n").alias("t"))
    classes = all_.select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("label"), "t").join(per, "label", "left")
    classes = classes.select("label", F.coalesce("n", F.lit(0.0)).alias("n"), (F.coalesce("n", F.lit(0.0)) / F.col("t")).alias("prior"))
    grid = size.select("j", "n_categories", F.explode(F.sequence(F.lit(0), F.col("n_categories") - 1)).alias("value")).join(small(classes), F.lit(True))
    full = grid.join(seen, ["label", "j", "value"], "left").withColumn("category_count", F.coalesce("category_count", F.lit(0)))
    p = F.try_divide(F.col("category_count") + alpha, F.col("n") + F.col("n_categories") * alpha)
    log = F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf")))
    stats = full.select("label", "j", "value", "category_count", "n_categories", log.alias("feature_log_prob"))
    return CategoricalNB(classes, stats, "categorical")
