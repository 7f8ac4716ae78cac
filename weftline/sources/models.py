"""Saving and loading of fitted models: JSON text, and Parquet for the tables of models that have some."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from weftline.errors import ParametersError
from weftline.functions import distance, kernels
from weftline.operators import cluster, decomposition, linear, logistic, naive_bayes, neighbors, preprocessing, solvers, svm, tree

_KINDS = {c.__name__: c for c in (cluster.KMeans, cluster.DBSCAN, naive_bayes.NaiveBayes, naive_bayes.CategoricalNB, neighbors.KNNClassifier, neighbors.KNNRegressor, solvers.TallQR, solvers.TallSVD, decomposition.Projection, linear.LinearModel, logistic.LogisticModel, preprocessing.StandardScaler, preprocessing.CategoryMapper, preprocessing.OneHotEncoder, svm.SupportVectors, svm.SupportTable, tree.Forest, tree.Node, kernels.Linear, kernels.RBF, kernels.Polynomial, kernels.Sigmoid)}


#: Functions that a model may hold, by name.
_FUNCTIONS = {f.__name__: f for f in (distance.euclidian, distance.squared_euclidian, distance.manhattan, distance.hamming)}


def to_json(value, tables: list[DataFrame] | None = None):
    """A model, or anything in one, as plain JSON values; tables are put into ``tables`` and stand as their numbers."""
    if isinstance(value, np.ndarray):
        return {"array": value.tolist()}
    if isinstance(value, DataFrame):
        if tables is None:
            raise ParametersError("a model with tables has no text alone; save it")
        tables.append(value)
        return {"table": len(tables) - 1}
    if dataclasses.is_dataclass(value):
        kept = [f.name for f in dataclasses.fields(value) if f.init]
        return {"kind": type(value).__name__, "fields": {n: to_json(getattr(value, n), tables) for n in kept}}
    if isinstance(value, tuple):
        return {"tuple": [to_json(v, tables) for v in value]}
    if isinstance(value, list):
        return [to_json(v, tables) for v in value]
    if callable(value):
        if _FUNCTIONS.get(getattr(value, "__name__", None)) is not value:
            raise ParametersError(f"{value} cannot be saved with a model")
        return {"function": value.__name__}
    return value.item() if isinstance(value, np.generic) else value


def from_json(value, table=None):
    """The inverse; ``table`` gives the tables by number."""
    if isinstance(value, list):
        return [from_json(v, table) for v in value]
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return np.array(value["array"])
    if "tuple" in value:
        return tuple(from_json(v, table) for v in value["tuple"])
    if "function" in value:
        return _FUNCTIONS[value["function"]]
    if "table" in value:
        return table(value["table"])
    return _KINDS[value["kind"]](**{k: from_json(v, table) for k, v in value["fields"].items()})


def save(spark: SparkSession, model, path: str) -> None:
    """Write a model into the folder ``path``, over what is there."""
    tables: list[DataFrame] = []
    text = json.dumps(to_json(model, tables))
    for i, t in enumerate(tables):
        t.write.mode("overwrite").parquet(f"{path}/table-{i}")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load(spark: SparkSession, path: str):
    text = spark.read.text(f"{path}/model", wholetext=True).first()[0]
    return from_json(json.loads(text), lambda i: spark.read.parquet(f"{path}/table-{i}"))
