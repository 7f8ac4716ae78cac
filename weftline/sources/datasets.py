"""Labelled datasets: generators, and the flat binary format of features and targets."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.sources.xy import read_xy, write_xy


def make_blobs(spark: SparkSession, n: int, features: int, centers: int, seed: int = 0) -> DataFrame:
    """(id, features, label): normal blobs of deviation 1 around uniform centres in (-10, 10); label = id % centers."""
    label = F.col("id") % centers
    unit = lambda j: F.pmod(F.xxhash64(label, F.lit(j), F.lit(seed)), F.lit(2**53)) / float(2**53)
    v = F.array(*(20 * unit(j) - 10 + F.randn(seed * 1000 + j + 1) for j in range(features)))
    return spark.range(n).select("id", v.alias("features"), label.cast("int").alias("label"))


def _noise(noise: float, seed: int):
    return noise * F.randn(seed) if noise else F.lit(0.0)


def make_circles(spark: SparkSession, n: int, factor: float = 0.8, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, features, label): a circle of radius 1 (label 0) and one of ``factor`` (label 1) inside."""
    outer = n // 2
    inner = n - outer
    far = F.col("id") < outer
    angle = F.when(far, 2 * F.pi() * F.col("id") / outer).otherwise(2 * F.pi() * (F.col("id") - outer) / inner)
    r = F.when(far, 1.0).otherwise(factor)
    v = F.array(r * F.cos(angle) + _noise(noise, seed + 1), r * F.sin(angle) + _noise(noise, seed + 2))
    return spark.range(n).select("id", v.alias("features"), F.when(far, 0).otherwise(1).alias("label"))


def make_moons(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, features, label): two half circles that reach into each other."""
    outer = n // 2
    inner = n - outer
    far = F.col("id") < outer
    angle = F.when(far, F.pi() * F.col("id") / outer).otherwise(F.pi() * (F.col("id") - outer) / inner)
    x = F.when(far, F.cos(angle)).otherwise(1 - F.cos(angle))
    y = F.when(far, F.sin(angle)).otherwise(0.5 - F.sin(angle))
    v = F.array(x + _noise(noise, seed + 1), y + _noise(noise, seed + 2))
    return spark.range(n).select("id", v.alias("features"), F.when(far, 0).otherwise(1).alias("label"))


def constant(spark: SparkSession, rows: int, columns: int, value: float = 0.0) -> DataFrame:
    """A matrix of one value, packed."""
    return spark.range(rows).select("id", F.array_repeat(F.lit(float(value)), columns).alias("features"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    """The identity matrix as cells (i, j, value)."""
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").cast("int").alias("j"), F.lit(1.0).alias("value"))


def random(spark: SparkSession, rows: int, columns: int, seed: int = 0) -> DataFrame:
    return spark.range(rows).select("id", F.array(*(F.rand(seed + j) for j in range(columns))).alias("features"))


def xy_bytes(features: np.ndarray, target: np.ndarray) -> bytes:
    """The flat binary form of a small dataset."""
    x = np.asarray(features, "<f4")
    return struct.pack("<QQ", x.shape[1], x.shape[0]) + x.tobytes() + np.asarray(target, "<f4").tobytes()
