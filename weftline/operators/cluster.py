"""K-means by one aggregation a step, and density clustering by joins and components."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weftline.errors import FitFailed
from weftline.functions.distance import Distance, euclidian, is_metric, squared_euclidian
from weftline.operators import pairs as blocks
from weftline.operators.components import connected_components
from weftline.operators.metric import Balls, balls, finite
from weftline.operators.neighbors import by_balls, radius
from weftline.operators.selection import numbered
from weftline.session import discard, materialise


@dataclass(frozen=True)
class KMeans:
    """k centroids; they are one constant of the plan, so assignment needs no join."""

    centroids: tuple[tuple[float, ...], ...]
    sizes: tuple[int, ...] = ()
    distortion: float = 0.0
    n_iter: int = 0
    converged: bool = True

    def nearest(self, features: Column) -> Column:
        """struct(d, cluster) of the nearest centroid, the lowest number among equals."""
        v = features.cast("array<double>")
        # The optimiser folds the text into one constant, whatever the number of centroids.
        centres = F.from_json(F.lit(json.dumps(self.centroids)), "array<array<double>>")
        return F.array_min(F.transform(centres, lambda c, i: F.struct(squared_euclidian(v, c).alias("d"), i.alias("cluster"))))

    def predict(self, df: DataFrame, features: str = "features", name: str = "cluster") -> DataFrame:
        return df.withColumn(name, self.nearest(F.col(features))["cluster"])

    def step(self, df: DataFrame, features: str = "features") -> KMeans:
        """One pass of Lloyd's algorithm; a cluster without rows keeps its centroid.

        Tasks add up Arrow batches, so what is exchanged is k sums for each task.
        """
        centres = np.array(self.centroids, float)
        k, dims = centres.shape

        def run(batches):
            total = np.zeros((k, dims + 2))
            for v in _blocks(batches, dims):
                d = _distances(v, centres)
                near = d.argmin(1)
                total[:, 0] += np.bincount(near, minlength=k)
                total[:, 1] += np.bincount(near, weights=d[np.arange(len(v)), near], minlength=k)
                np.add.at(total, (near, slice(2, None)), v)
            used = np.repeat(total[:, 0] > 0, dims + 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(used), pa.int64()), pa.array(total.ravel()[used])], names=["i", "s"])

        total = np.zeros(k * (dims + 2))
        for r in _vectors(df, features).mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
            total[r.i] = r.s
        total = total.reshape(k, -1)
        full = total[:, 0] > 0
        centres[full] = total[full, 2:] / total[full, :1]
        return KMeans(tuple(map(tuple, centres.tolist())), tuple(int(n) for n in total[:, 0]), float(total[:, 1].sum()), self.n_iter + 1, False)


def _vectors(df: DataFrame, features: str) -> DataFrame:
    return df.select(F.col(features).cast("array<double>").alias("v")).where("v is not null")


def _blocks(batches, dims: int):
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            yield part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, one centroid at a time, so equal rows are at distance zero exactly."""
    return np.stack([((v - c) ** 2).sum(1) for c in centres], 1)


def _spread_seeds(rows: DataFrame, k: int, seed: int, rounds: int = 5) -> KMeans:
    """Seeds by a few rounds of oversampling, weighted and thinned to k.

    In each round a row is taken with a probability in proportion to its squared
    distance from what is taken already, 2 k rows expected, by a hash. The rows
    taken, weighted by how many rows are nearest to them, are few: k of them are
    drawn on the driver, each next one in proportion to weight and distance.
    """
    first = rows.orderBy(F.xxhash64("v", F.lit(seed)), "v").first()
    if first is None:
        raise FitFailed("there are no rows")
    dims, taken = len(first.v), np.array([first.v])

    def nearest(v: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return _distances(v, marks).min(1)

    for i in range(rounds):
        cost = KMeans(tuple(map(tuple, taken.tolist()))).step(rows, "v").distortion
        if cost == 0:
            break
        marks = taken

        def run(batches, cost=cost, marks=marks):
            for b in batches:
                u = b.column(1).to_numpy(zero_copy_only=False)
                at = 0
                for v in _blocks([b], dims):
                    hit = u[at : at + len(v)] * cost < 2 * k * nearest(v, marks)
                    at += len(v)
                    yield pa.RecordBatch.from_arrays([pa.array(list(v[hit]), pa.list_(pa.float64()))], names=["v"])

        u = (F.pmod(F.xxhash64("v", F.lit(seed), F.lit(i)), F.lit(2**53)) + 0.5) / float(2**53)
        found = rows.select("v", u.alias("u")).mapInArrow(run, "v array<double>").distinct().collect()
        if found:
            taken = np.unique(np.vstack((taken, [r.v for r in found])), axis=0)
    weight = np.array(KMeans(tuple(map(tuple, taken.tolist()))).step(rows, "v").sizes, float)
    rng = np.random.Generator(np.random.PCG64(seed))
    picked = [int(rng.choice(len(taken), p=weight / weight.sum()))]
    while len(picked) < k:
        far = weight * nearest(taken, taken[picked])
        picked.append(int(rng.choice(len(taken), p=far / far.sum())) if far.sum() > 0 else picked[0])
    return KMeans(tuple(map(tuple, taken[picked].tolist())))


def kmeans(df: DataFrame, k: int = 2, max_iter: int = 100, features: str = "features", seed: int = 0, init: KMeans | None = None) -> KMeans:
    """Lloyd's algorithm until the distortion no longer falls."""
    if k < 2:
        raise FitFailed(f"{k} clusters asked, two are the least")
    if max_iter <= 0:
        raise FitFailed(f"max_iter is {max_iter}, but at least one step is needed")
    rows = materialise(_vectors(df, features), "points")
    model, last = init or _spread_seeds(rows, k, seed), float("inf")
    for _ in range(max_iter):
        new = model.step(rows, "v")
        if new.distortion >= last:
            return KMeans(model.centroids, new.sizes, new.distortion, model.n_iter, True)
        model, last = new, new.distortion
    return model


@dataclass
class DBSCAN:
    """Training rows with their labels: -1 for noise, clusters from 0 in the order of their first row."""

    labels: DataFrame
    eps: float
    distance: Distance = euclidian
    id_col: str = "id"
    features: str = "features"
    how: str = "auto"

    def predict(self, queries: DataFrame) -> DataFrame:
        """(query_id, prediction): the commonest label within eps as cluster + 1, noise and nobody near as 0.

        Equal counts go to the lower cluster, noise comes last.
        """
        of = self.labels.select(F.col(self.id_col).cast("long").alias("id"), "cluster")
        rows, asked = _points(self.labels, self.id_col, self.features), _points(queries, self.id_col, self.features)
        if _in_blocks(self.distance, rows, asked):
            votes = self._votes(rows.where(finite("v")).join(of, "id"), asked.where(finite("v")))
        else:
            near = radius(self.labels, queries, self.eps, self.id_col, self.features, self.distance, self.how)
            votes = near.join(of, "id").groupBy("query_id", "cluster").agg(F.count(F.lit(1)).alias("c"))
        place = F.when(F.col("cluster") < 0, F.lit(2**62)).otherwise(F.col("cluster"))
        best = votes.groupBy("query_id").agg(F.max_by("cluster", F.struct("c", -place)).alias("cluster"))
        every = queries.select(F.col(self.id_col).cast("long").alias("query_id")).join(best, "query_id", "left")
        return every.select("query_id", (F.coalesce("cluster", F.lit(-1)) + 1).alias("prediction"))

    def _votes(self, rows: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, cluster, c) of rows (id, v, cluster): blocks count what is near, equal vectors once."""
        of = _distinct(rows, ["v", "cluster"], "voters")
        asked = _distinct(queries, ["v"], "askers")
        b = _partition(of, asked, self.distance, self.how)
        if not b.lines:
            return of.select(F.col("class").alias("query_id"), F.col("cluster").cast("long").alias("cluster"), F.col("w").alias("c")).limit(0)
        matrix, eps = self.distance.matrix, self.eps

        def count(left: pa.Table, right: pa.Table) -> pa.Table:
            near = blocks.within(matrix, eps, left, right)
            found, which = np.unique(left["cluster"].to_numpy(), return_inverse=True)
            share = np.zeros((near.shape[1], min(len(found), _VOTED)))
            out = []
            # Clusters are counted some at a time, so the counts of a block are bounded too.
            for at in range(0, len(found), _VOTED):
                mine = np.flatnonzero((which >= at) & (which < at + _VOTED))
                share[:] = 0
                share[mine, which[mine] - at] = left["w"].to_numpy()[mine]
                n = near.astype(float) @ share
                i, j = np.nonzero(n)
                out.append((right["query_id"].to_numpy()[i], found[at + j], n[i, j]))
            i, c, n = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.table({"class": pa.array(i, pa.int64()), "cluster": pa.array(c, pa.int64()), "c": pa.array(n.astype(np.int64))})

        near = b.met(b.asked(b.placed(asked, "class", "v"), F.lit(float(eps))), count, _with(b, of, F.col("cluster").cast("long").alias("cluster"), "w"), "class long, cluster long, c long")
        votes = materialise(near.groupBy("class", "cluster").agg(F.sum("c").alias("c")), "votes")
        own = queries.join(asked.select("v", "class"), "v").select(F.col("id").alias("query_id"), "class")
        return own.join(votes, "class").groupBy("query_id", "cluster").agg(F.sum("c").alias("c"))


#: Clusters whose votes a task counts at once.
_VOTED = 256


def _points(df: DataFrame, id_col: str, features: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(features).cast("array<double>").alias("v"))


def _in_blocks(distance: Distance, *tables: DataFrame) -> bool:
    """Whether blocks of finite vectors give all that is near: a metric with a matrix form, vectors of one length.

    Vectors with a null, NaN or infinite component must be near nothing, as is so where NaN makes the distance NaN.
    """
    if not is_metric(distance) or getattr(distance, "matrix", None) is None:
        return False
    told = [t.agg(F.min(F.size("v")), F.max(F.size("v")), F.count(F.when(~finite("v"), 1))).first() for t in tables]
    sizes = {n for low, high, _ in told for n in (low, high) if n is not None and n >= 0}
    none = np.full((1, 1), np.nan)
    return len(sizes) <= 1 and (not any(odd for *_, odd in told) or bool(np.isnan(distance.matrix(none, none)[0, 0])))


def _distinct(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The distinct vectors with a number ``class`` and how many rows have them, ``w``: equal rows have equal neighbours."""
    return materialise(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("w")).withColumn("class", F.monotonically_increasing_id()), name)


def _partition(classes: DataFrame, queries: DataFrame, distance: Distance, how: str) -> Balls:
    """The balls of distinct vectors; all pairs are those of one ball, cut into chunks as any other."""
    return balls(classes, "class", "v", distance, None if by_balls(classes, queries, distance, how) else 1)


def _with(b: Balls, classes: DataFrame, *columns: Column | str) -> DataFrame:
    return b.rows.join(classes.select(F.col("class").alias("id"), *columns), "id")


def _roots_in_blocks(rows: DataFrame, eps: float, min_samples: int, distance: Distance, how: str) -> DataFrame:
    """(id, root) of core and border rows of (id, v), where root is the first core row of the cluster.

    Pairs within eps are never written. Blocks of distinct vectors add up how many
    rows are near; then those of core rows tell their components among themselves by
    a link for each row at most, and at last the first root near each other row.
    """
    classes = _distinct(rows, ["v"], "distinct-points")
    b = _partition(classes, classes, distance, how)
    if not b.lines:
        return rows.select("id", F.col("id").alias("root")).limit(0)
    placed, matrix, reach = b.placed(classes, "class", "v"), distance.matrix, F.lit(float(eps))
    asked = materialise(b.asked(placed, reach), "asked")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        n = blocks.within(matrix, eps, left, right).astype(float) @ left["w"].to_numpy().astype(float)
        return pa.table({"class": right["query_id"].cast(pa.int64()), "n": pa.array(n.astype(np.int64))})

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = blocks.stars(blocks.within(matrix, eps, left, right), left["id"].to_numpy(), right["query_id"].to_numpy())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left["root"].to_numpy(), kind="stable")
        near = blocks.within(matrix, eps, left.take(pa.array(order)), right)
        hit, at = near.any(1), near.argmax(1)
        return pa.table({"class": pa.array(right["query_id"].to_numpy()[hit], pa.int64()), "root": pa.array(left["root"].to_numpy()[order][at[hit]], pa.int64())})

    counts = materialise(b.met(asked, count, _with(b, classes, "w"), "class long, n long").groupBy("class").agg(F.sum("n").alias("n")), "near-counts")
    # Rows of one id, should there be several, are one.
    member = rows.where("id is not null").join(classes.select("v", "class"), "v").select("id", "class")
    core = member.join(counts, "class").groupBy("id").agg((F.sum("n") >= min_samples).alias("core"), F.min("class").alias("least"), F.max("class").alias("most"))
    member = materialise(member.join(core, "id"), "members")
    heads = materialise(member.where("core").groupBy("class").agg(F.min("id").alias("first")), "core")
    of_core = asked.join(heads.select(F.col("class").alias("query_id")), "query_id")
    links = b.met(of_core, link, _with(b, heads), "a long, b long")
    links = links.union(member.where("core and least < most").select(F.col("class").alias("a"), F.col("least").alias("b")))
    label = heads.join(connected_components(links).toDF("class", "label"), "class", "left").select("class", "first", F.coalesce("label", "class").alias("label"))
    roots = materialise(label.join(label.groupBy("label").agg(F.min("first").alias("root")), "label").select("class", "root"), "roots")
    other = member.where("not core").select(F.col("class").alias("query_id")).distinct()
    border = b.met(asked.join(other, "query_id"), first, _with(b, roots, "root"), "class long, root long").groupBy("class").agg(F.min("root").alias("root"))
    out = member.where("core").join(roots, "class").union(member.where("not core").join(border, "class"))
    out = materialise(out.groupBy("id").agg(F.min("root").alias("root")), "rooted")
    discard(classes, asked, counts, member, heads, roots)
    return out


def _roots_of_pairs(near: DataFrame, min_samples: int) -> DataFrame:
    """The same of a table of neighbours (query_id, id)."""
    near = materialise(near.select("query_id", "id"), "near")
    core = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_samples).select(F.col("query_id").alias("core"))
    core = materialise(core, "core")
    links = near.join(core, F.col("query_id") == F.col("core")).drop("core").join(core, F.col("id") == F.col("core")).select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    joined = connected_components(links).toDF("core", "root")
    root = materialise(core.join(joined, "core", "left").select(F.col("core").alias("of"), F.coalesce("root", "core").alias("root")), "roots")
    border = near.join(root, F.col("id") == F.col("of")).groupBy("query_id").agg(F.min("root").alias("first"))
    both = root.join(border, F.col("of") == F.col("query_id"), "full")
    return materialise(both.select(F.coalesce("of", "query_id").alias("id"), F.coalesce("root", "first").alias("root")), "rooted")


def dbscan(df: DataFrame, eps: float = 0.5, min_samples: int = 5, distance: Distance = euclidian, id_col: str = "id", features: str = "features", pairs: DataFrame | None = None, how: str = "auto") -> DBSCAN:
    """Density clustering; ``pairs`` (query_id, id) may bring a ready-made neighbour table.

    Neighbours are found by ``how`` as ``neighbors.radius`` does: by the balls of a metric, or among all pairs.
    Distances with a matrix form are compared in blocks that write no pairs.

    Core rows have at least ``min_samples`` rows within eps, themselves included;
    clusters are the components of core rows, border rows join the neighbouring
    cluster that comes first.
    """
    if min_samples < 1:
        raise FitFailed(f"a core row needs at least one neighbour, not {min_samples}")
    if eps <= 0:
        raise FitFailed(f"a neighbourhood of radius {eps} is empty")
    rows = _points(df, id_col, features)
    if pairs is None and _in_blocks(distance, rows):
        rooted = _roots_in_blocks(rows.where(finite("v")), eps, min_samples, distance, how)
    else:
        rooted = _roots_of_pairs(radius(df, df, eps, id_col, features, distance, how) if pairs is None else pairs, min_samples)
    numbers = numbered(rooted.select("root").distinct(), ["root"], "cluster")
    of = rooted.join(numbers, "root").select(F.col("id").alias("__id"), "cluster")
    label = df.withColumn("__id", F.col(id_col).cast("long")).join(of, "__id", "left").drop("__id")
    return DBSCAN(label.withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long"))), eps, distance, id_col, features, how)
