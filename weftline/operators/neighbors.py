"""Neighbour search as joins, and the models that vote by it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftline.errors import FindFailed, ParametersError
from weftline.frame import BROADCAST_ROWS
from weftline.functions.distance import Distance, euclidian, is_metric, squared_euclidian
from weftline.operators import pairs
from weftline.operators.metric import balls, knn_join, radius_join
from weftline.session import materialise


#: Pairs of rows and queries up to which all are compared; beyond it a metric's balls leave most out.
ALL_PAIRS = 200_000_000
#: Rows whose closest two bound the search for the closest of all.
SAMPLE = 500


def _pairs(data: DataFrame, queries: DataFrame, id_col: str, features: str) -> DataFrame:
    """(id, v, query_id, q): all rows beside all queries.

    Few queries are broadcast. Many are cut into blocks that data rows are dealt
    to by an equality join, so neither side has to fit one task.
    """
    v = lambda d, i, x: d.select(F.col(id_col).cast("long").alias(i), F.col(features).cast("array<double>").alias(x))
    left, right = v(data, "id", "v"), v(queries, "query_id", "q")
    blocks = -(-right.count() // BROADCAST_ROWS)
    if blocks <= 1:
        return left.join(F.broadcast(right), F.lit(True))
    right = right.withColumn("__b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    return left.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(right, "__b").drop("__b")


def compared(data: DataFrame, queries: DataFrame, f, id_col: str = "id", features: str = "features") -> DataFrame:
    """(query_id, id, value): a distance or a kernel of all rows with all queries.

    Those that have a matrix form are worked out in blocks, others pair by pair.
    """
    column = getattr(f, "column", f)

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        both = _pairs(left.toDF("id", "features"), right.toDF("id", "features"), "id", "features")
        return both.select("query_id", "id", column(F.col("v"), F.col("q")).alias("value"))

    if getattr(f, "matrix", None) is None:
        return beside(*(d.select(id_col, features) for d in (data, queries)))
    return pairs.every(data, queries, id_col, features, f, beside)


def _near(data: DataFrame, queries: DataFrame, id_col: str, features: str, distance: Distance, **kept) -> DataFrame:
    """(query_id, id, distance) of what may be asked for: all pairs, or with a matrix form what blocks leave of them."""

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        both = _pairs(left.toDF("id", "features"), right.toDF("id", "features"), "id", "features")
        both = both if kept.get("keep_self", True) else both.where("id <> query_id")
        return both.select("query_id", "id", distance(F.col("v"), F.col("q")).alias("distance"))

    if getattr(distance, "matrix", None) is None:
        return beside(*(d.select(id_col, features) for d in (data, queries)))
    return pairs.every(data, queries, id_col, features, distance, beside, **kept).withColumnRenamed("value", "distance")


def by_balls(data: DataFrame, queries: DataFrame, distance: Distance, how: str) -> bool:
    if how not in ("auto", "pairs", "balls"):
        raise ParametersError(f"a search goes by auto, pairs or balls, not {how}")
    if how == "balls" and not is_metric(distance):
        raise ParametersError("only a metric's balls tell what is near; mark it by functions.distance.metric")
    return how == "balls" or how == "auto" and is_metric(distance) and data.count() * queries.count() > ALL_PAIRS


def knn(data: DataFrame, queries: DataFrame, k: int, id_col: str = "id", features: str = "features", distance: Distance = euclidian, keep_self: bool = True, how: str = "auto") -> DataFrame:
    """(query_id, id, distance, rnk): the k nearest rows of each query, ties to the smaller id.

    ``how`` is ``pairs`` to compare all, ``balls`` to leave out what the triangle
    inequality excludes, and by default the one or the other by the number of pairs.
    """
    if k < 1:
        raise FindFailed("k should be at least 1")
    if data.limit(k).count() < k:
        raise FindFailed("k is larger than the number of rows")
    if by_balls(data, queries, distance, how):
        return knn_join(balls(data, id_col, features, distance), queries, k, id_col, features, keep_self)
    near = _near(data, queries, id_col, features, distance, k=k, keep_self=keep_self)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def radius(data: DataFrame, queries: DataFrame, r: float, id_col: str = "id", features: str = "features", distance: Distance = euclidian, how: str = "auto") -> DataFrame:
    """(query_id, id, distance): all rows within r, the bound included; ``how`` is as in ``knn``."""
    if r <= 0:
        raise FindFailed("the radius should be positive")
    if by_balls(data, queries, distance, how):
        return radius_join(balls(data, id_col, features, distance), queries, r, id_col, features)
    return _near(data, queries, id_col, features, distance, r=r).where(F.col("distance") <= r)


def radius_grid(data: DataFrame, r: float, id_col: str = "id", features: str = "features", dims: int = 2) -> DataFrame:
    """(query_id, id, distance) of all pairs within a Euclidian radius, self included, by cells of that width.

    Cells are over the first ``dims`` components, in which rows within the radius
    are too; the rest is left to the distance. Each row is asked from the 3**dims
    cells around it, so the join is on equality of cells.
    """
    cell = lambda move: F.array(*(F.floor(F.col("v")[d] / r) + (move[d] if move is not None else 0) for d in range(dims)))
    v = data.select(F.col(id_col).cast("long").alias("id"), F.col(features).cast("array<double>").alias("v"))
    moves = [[]]
    for _ in range(dims):
        moves = [[*m, d] for m in moves for d in (-1, 0, 1)]
    around = v.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.explode(F.array(*(cell(m) for m in moves))).alias("cell"))
    own = v.select("id", "v", cell(None).alias("cell"))
    # A full cell is cut into parts by its rows, each of which meets all that ask for the cell.
    full = materialise(own.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / pairs.ROWS).cast("int").alias("parts")), "cells")
    tasks = max(1, min(pairs.MOST_PARTITIONS, full.agg(F.sum("parts")).first()[0] or 0))
    own = own.join(full, "cell").withColumn("part", pairs.part_of("id", F.col("parts"))).drop("parts").repartition(tasks, "cell", "part")
    around = around.join(full, "cell").withColumn("part", pairs.upto(F.col("parts"))).drop("parts").repartition(tasks, "cell", "part")
    d = squared_euclidian(F.col("v"), F.col("q"))
    near = own.join(around.hint("shuffle_hash"), ["cell", "part"]).select("query_id", "id", F.sqrt(d).alias("distance"), d.alias("squared"))
    return near.where(F.col("distance") <= r)


#: Components of a block of rows that the closest pair is looked for in, blocks at least, and rows compared at once.
CLOSEST_VALUES, CLOSEST_BLOCKS, CLOSEST_ROWS = 1 << 20, 12, 1024


def _closest_in_blocks(v: DataFrame, bound: float, distance: Distance) -> DataFrame:
    """(node, neighbour, distance): the closest two rows of each pair of blocks that has any within the bound.

    Euclidian distances are first told from inner products; those that rounding
    leaves open are worked out from the differences.
    """
    finite = F.coalesce(F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = v.where(F.col("id").isNotNull() & finite).select("id", F.col("features").alias("v"))
    n, least, dims = rows.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    dims = dims or 0
    if n and least != dims:
        raise ParametersError("vectors differ in length")
    blocks = max(pairs.chunks(n, dims, max(1, CLOSEST_VALUES // max(1, dims))), min(CLOSEST_BLOCKS, pairs.chunks(n, dims)))
    matrix, by_products = distance.matrix, distance is euclidian

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = pairs.vectors(left["v"]), pairs.vectors(right["w"])
        ai, bi = left["id"].to_numpy(), right["other"].to_numpy()
        same = left["ca"][0].as_py() == left["cb"][0].as_py()
        best = (np.inf if bound is None or bound != bound else bound * (1 + 1e-9), 2**63 - 1, 2**63 - 1)
        if by_products:
            centre = a.mean(0)
            ca, cb = a - centre, b - centre
            na, nb = (ca * ca).sum(1), (cb * cb).sum(1)
            rounding = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (na.max() + nb.max())
        for i in range(0, len(a), CLOSEST_ROWS):
            for j in range(0, len(b), CLOSEST_ROWS):
                p, q = slice(i, i + CLOSEST_ROWS), slice(j, j + CLOSEST_ROWS)
                if by_products:
                    d = ca[p] @ (-2 * cb[q]).T
                    d += na[p, None]
                    d += nb[q]
                    x, y = np.nonzero(~(d > best[0] ** 2 + rounding))
                    once = ai[p][x] < bi[q][y] if same else slice(None)
                    x, y = x[once], y[once]
                    value = np.zeros(len(x))
                    for f in range(a.shape[1]):
                        value += (a[p, f][x] - b[q, f][y]) ** 2
                    value = np.sqrt(value)
                else:
                    d = matrix(a[p], b[q])
                    x, y = np.nonzero((d <= best[0]) & ((ai[p, None] < bi[q]) | (not same)))
                    value = d[x, y]
                if len(x):
                    node, other = np.minimum(ai[p][x], bi[q][y]), np.maximum(ai[p][x], bi[q][y])
                    first = np.lexsort((other, node, value))[0]
                    best = min(best, (float(value[first]), int(node[first]), int(other[first])))
        found = best[2] != 2**63 - 1
        return pa.table({"node": pa.array([best[1]][:found], pa.int64()), "neighbour": pa.array([best[2]][:found], pa.int64()), "distance": pa.array([best[0]][:found], pa.float64())})

    # Each two blocks meet once, a block with itself too.
    own = pairs.part_of("id", blocks)
    later = rows.select("id", "v", own.alias("ca"), F.explode(F.sequence(own, F.lit(blocks - 1))).alias("cb"))
    sooner = rows.select(F.col("id").alias("other"), F.col("v").alias("w"), F.explode(F.sequence(F.lit(0), own)).alias("ca"), own.alias("cb"))
    parts = min(pairs.MOST_PARTITIONS, blocks * (blocks + 1) // 2)
    left, right = (df.repartition(parts, "ca", "cb").groupBy("ca", "cb") for df in (later, sooner))
    empty = pa.schema([("node", pa.int64()), ("neighbour", pa.int64()), ("distance", pa.float64())]).empty_table()
    return left.cogroup(right).applyInArrow(lambda x, y: work(x, y) if x.num_rows and y.num_rows else empty, "node long, neighbour long, distance double")


def closest_pair(data: DataFrame, id_col: str = "id", features: str = "features", distance: Distance = euclidian) -> DataFrame:
    """(node, neighbour, distance, squared) of the two closest rows, the smallest ids among ties.

    Equal rows are found by grouping. Without any, the closest two of a bounded
    sample bound the distance. A distance with a matrix form is then tried on all
    pairs in blocks, of which each task tells the closest two; for others a radius
    join finds the pairs within the bound.
    """
    if data.limit(3).count() < 3:
        raise ParametersError("at least three rows are needed")
    v = materialise(data.select(F.col(id_col).cast("long").alias("id"), F.col(features).cast("array<double>").alias("features")), "closest-rows")
    twice = v.groupBy("features").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("node").limit(1)
    if not (twice := materialise(twice, "equal-rows")).isEmpty():
        pair = v.join(F.broadcast(twice), "features").where("id > node").groupBy("node").agg(F.min("id").alias("neighbour"))
        return pair.select("node", "neighbour", F.lit(0.0).alias("distance"), F.lit(0.0).alias("squared"))
    some = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    bound = _pairs(some, some, "id", "features").where("id > query_id").agg(F.min(distance(F.col("v"), F.col("q")))).first()[0]
    if is_metric(distance) and getattr(distance, "matrix", None):
        near = _closest_in_blocks(v, bound, distance)
        return near.select("node", "neighbour", "distance", (F.col("distance") * F.col("distance")).alias("squared")).orderBy("distance", "node", "neighbour").limit(1)
    near = radius_join(balls(v, "id", "features", distance), v, bound * (1 + 1e-9)) if is_metric(distance) else radius(v, v, bound * (1 + 1e-9), distance=distance, how="pairs")
    near = near.where("id > query_id").select(F.col("query_id").alias("node"), F.col("id").alias("neighbour"), "distance", (F.col("distance") * F.col("distance")).alias("squared"))
    return near.orderBy("distance", "node", "neighbour").limit(1)


def _weights(near: DataFrame, weight: str) -> DataFrame:
    """Adds ``w``: 1, or 1 / distance, where zero distances take all the weight of their query."""
    if weight == "uniform":
        return near.withColumn("w", F.lit(1.0))
    if weight != "distance":
        raise ParametersError("weight is uniform or distance")
    zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query_id"))
    return near.withColumn("z", zero).withColumn("w", F.when(F.col("z") == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))).drop("z")


@dataclass
class KNNClassifier:
    data: DataFrame
    label: str
    k: int = 3
    weight: str = "uniform"
    distance: Distance = euclidian
    id_col: str = "id"
    features: str = "features"

    def __post_init__(self):
        if self.k < 2:
            raise ParametersError(f"a vote needs two neighbours at least, not {self.k}")

    def predict(self, queries: DataFrame) -> DataFrame:
        """(query_id, prediction): the label of most weight; among equals the one whose neighbour comes first."""
        near = _weights(knn(self.data, queries, self.k, self.id_col, self.features, self.distance), self.weight)
        labelled = near.join(self.data.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.label).alias("label")), "id")
        votes = labelled.groupBy("query_id", "label").agg(F.sum("w").alias("w"), F.min("rnk").alias("rnk"))
        return votes.groupBy("query_id").agg(F.max_by("label", F.struct("w", -F.col("rnk"))).alias("prediction"))


@dataclass
class KNNRegressor:
    data: DataFrame
    target: str
    k: int = 3
    weight: str = "uniform"
    distance: Distance = euclidian
    id_col: str = "id"
    features: str = "features"

    def __post_init__(self):
        if self.k < 1:
            raise ParametersError(f"a mean needs a neighbour at least, not {self.k}")

    def predict(self, queries: DataFrame) -> DataFrame:
        """(query_id, prediction): the weighted mean of the neighbours' targets."""
        near = _weights(knn(self.data, queries, self.k, self.id_col, self.features, self.distance), self.weight)
        y = self.data.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.target).cast("double").alias("y"))
        return near.join(y, "id").groupBy("query_id").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"))
