"""Streams: scoring by fitted models, and statistics that are kept up to date.

A model's prediction is a column expression, so it applies to a streaming table
as it is. Sums for means, variances and Gram matrices add up, so they are plain
streaming aggregations, windowed by event time where a watermark bounds state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def score_stream(stream: DataFrame, model, **kwargs) -> DataFrame:
    """``model.predict`` on a streaming table; stateless."""
    return model.predict(stream, **kwargs)


def running_stats(stream: DataFrame, columns: Sequence[str], time: str | None = None, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count, mean and population variance of columns, in all or for each window of event time."""
    aggs = [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in columns for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))]
    if time is None:
        return stream.groupBy().agg(*aggs)
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(*aggs)


def running_gram(stream: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, sums and cross products of columns, from which linear models can be solved at any time."""
    x = [F.col(c).cast("double") for c in columns]
    sums = [F.sum(a).alias(f"s_{c}") for a, c in zip(x, columns, strict=True)]
    cross = [F.sum(x[i] * x[j]).alias(f"s_{columns[i]}__{columns[j]}") for i in range(len(x)) for j in range(i, len(x))]
    return stream.groupBy().agg(F.count(F.lit(1)).alias("n"), *sums, *cross)


def running_class_stats(stream: DataFrame, label: str, features: str = "features") -> DataFrame:
    """(label, j, n, theta, var): the statistics of a Gaussian naive Bayes model, kept by the stream."""
    cells = stream.select(F.col(label).alias("label"), F.posexplode(F.col(features).cast("array<double>")).alias("j", "value"))
    return cells.groupBy("label", "j").agg(F.count("value").alias("n"), F.avg("value").alias("theta"), F.var_pop("value").alias("var"))
