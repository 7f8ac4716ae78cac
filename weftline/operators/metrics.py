"""Evaluation metrics of a table of truths and predictions.

Each function returns one row with one column ``score`` (``hcv`` three), made by
aggregations alone. ``compat=True`` gives the conventions of the library whose
results are to be matched, in which the counts that binary precision and recall
divide by are exchanged; the default is the textbook definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.session import materialise


def _one(df: DataFrame, score: Column) -> DataFrame:
    return df.agg(score.cast("double").alias("score"))


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    """Share of equal labels."""
    return _one(df, F.avg((F.col(y) == F.col(p)).cast("double")))


def _rates(df: DataFrame, y: str, p: str, compat: bool) -> DataFrame:
    """(precision, recall). With other than two true classes both are the accuracy."""
    t, q = F.col(y).cast("double"), F.col(p).cast("double")
    count = lambda c: F.sum(c.cast("long")).cast("double")
    a = df.agg(
        F.count_distinct(t).alias("k"),
        count((t == 1) & (q == 1)).alias("tp"),
        count((t == 1) & (q != t)).alias("missed"),
        count((t != 1) & (q != t)).alias("raised"),
        count(t == q).alias("same"),
        F.count(t).cast("double").alias("n"),
    )
    own, other = ("missed", "raised") if compat else ("raised", "missed")
    share = lambda c: F.when(F.col("k") == 2, F.try_divide("tp", F.col("tp") + F.col(c))).otherwise(F.try_divide("same", "n"))
    return a.select(share(own).alias("precision"), share(other).alias("recall"))


def precision(df: DataFrame, y: str, p: str, compat: bool = False) -> DataFrame:
    return _rates(df, y, p, compat).select(F.col("precision").alias("score"))


def recall(df: DataFrame, y: str, p: str, compat: bool = False) -> DataFrame:
    return _rates(df, y, p, compat).select(F.col("recall").alias("score"))


def f_beta(df: DataFrame, y: str, p: str, beta: float = 1.0, compat: bool = False) -> DataFrame:
    b = F.lit(beta * beta)
    score = F.try_divide((1 + b) * F.col("precision") * F.col("recall"), b * F.col("precision") + F.col("recall"))
    return _rates(df, y, p, compat).select(score.alias("score"))


def roc_auc(df: DataFrame, y: str, s: str) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at their average rank; labels must be 0 or 1.

    Scores are counted per distinct value before they are ranked. The running
    count is taken within ranges of scores and then over the ranges, so no
    window holds all rows.
    """
    label = F.col(y).cast("double")
    sane = F.when(label.isin(0.0, 1.0), label).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("double"))
    per = df.groupBy(F.col(s).cast("double").alias("s")).agg(F.sum(sane).alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = per.repartitionByRange(parts, "s").withColumn("r", F.spark_partition_id())
    ranged = materialise(ranged, "scores")
    sums = ranged.groupBy("r").agg(F.sum("n").alias("rn"))
    before = sums.select("r", F.coalesce(F.sum("rn").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("base"))
    order = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.col("base") + F.sum("n").over(order) - (F.col("n") - 1) / 2
    ranked = ranged.join(F.broadcast(before), "r").select("pos", "n", rank.alias("rank"))
    a = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("w"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return a.select(F.try_divide(F.col("w") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("score"))


def mean_squared_error(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y).cast("double") - F.col(p).cast("double")
    return _one(df, F.avg(e * e))


def mean_absolute_error(df: DataFrame, y: str, p: str) -> DataFrame:
    return _one(df, F.avg(F.abs(F.col(y).cast("double") - F.col(p).cast("double"))))


def r2(df: DataFrame, y: str, p: str) -> DataFrame:
    """1 minus the residual over the total sum of squares, null for a constant truth."""
    t, e = F.col(y).cast("double"), F.col(y).cast("double") - F.col(p).cast("double")
    return _one(df, 1 - F.try_divide(F.sum(e * e), F.var_pop(t) * F.count(t)))


def contingency(df: DataFrame, y: str, p: str) -> DataFrame:
    """(truth, prediction, n) of all pairs that occur."""
    return df.groupBy(F.col(y).alias("truth"), F.col(p).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def entropy(df: DataFrame, y: str) -> DataFrame:
    """Entropy of a label column in nats."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return c.agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("score"))


def _information(df: DataFrame, y: str, p: str) -> DataFrame:
    """(mi, hy, hp): mutual information and both entropies, in nats."""
    n = contingency(df, y, p)
    xlogx = lambda c: F.sum(F.col(c) * F.log(F.col(c)))
    both = n.agg(xlogx("n").alias("b"), F.sum("n").cast("double").alias("all"))
    side = lambda c, name: n.groupBy(c).agg(F.sum("n").alias("n")).agg(xlogx("n").alias(name))
    a = both.crossJoin(side("truth", "t")).crossJoin(side("prediction", "q"))
    h = lambda c: F.log("all") - F.col(c) / F.col("all")
    return a.select(F.greatest(F.lit(0.0), h("t") + h("q") - h("b")).alias("mi"), h("t").alias("hy"), h("q").alias("hp"))


def mutual_information(df: DataFrame, y: str, p: str) -> DataFrame:
    return _information(df, y, p).select(F.col("mi").alias("score"))


def hcv(df: DataFrame, y: str, p: str) -> DataFrame:
    """(homogeneity, completeness, v_measure); a side with one class counts as 1."""
    ratio = lambda h: F.when(F.col(h) <= 1e-12, 1.0).otherwise(F.col("mi") / F.col(h))
    a = _information(df, y, p).select(ratio("hy").alias("homogeneity"), ratio("hp").alias("completeness"))
    v = F.coalesce(F.try_divide(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")), F.lit(0.0))
    return a.withColumn("v_measure", v)


CLASSIFICATION = {"accuracy": accuracy, "precision": precision, "recall": recall, "f_beta": f_beta, "roc_auc": roc_auc}
REGRESSION = {"mean_squared_error": mean_squared_error, "mean_absolute_error": mean_absolute_error, "r2": r2}
CLUSTERING = {"hcv": hcv, "mutual_information": mutual_information}


def score(metric: DataFrame) -> float:
    """The single number of a metric's one row."""
    return metric.first()[0]
