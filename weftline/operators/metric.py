"""Exact neighbour joins for any metric by a partition into balls.

A bounded number of rows are pivots. Each row lies in the ball of its nearest
pivot and keeps its distance from it; a ball is cut into RINGS rings of equal
width. A query keeps its distances from all pivots, and the triangle inequality
tells which rings may hold rows within a radius of it:

* a ring between the distances a and b from its pivot holds none if the query
  is more than the radius outside of [a, b] from that pivot;
* a ball holds none if its pivot is more than twice the radius farther from the
  query than the nearest pivot.

Queries meet rings by an equality join, a row is compared only if its own
distance from the pivot allows it, and what is left is decided by the distance
itself. Nothing but pivots and a line for each ball comes to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.errors import FindFailed
from weftline.functions.distance import Distance, euclidian
from weftline.operators import pairs
from weftline.session import materialise

#: Pivots at most, and their components in all.
MAX_PIVOTS, PIVOT_VALUES = 256, 1 << 18
RINGS = 16
#: A share of the distances that rounding may have changed.
ROUNDING = 1e-9


def finite(v: str) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _vectors(df: DataFrame, id_col: str, features: str, names: tuple[str, str]) -> DataFrame:
    v = df.select(F.col(f"`{id_col}`").cast("long").alias(names[0]), F.col(f"`{features}`").cast("array<double>").alias(names[1]))
    return v.where(F.col(names[0]).isNotNull() & finite(names[1]))


@dataclass(frozen=True)
class Balls:
    """Rows (id, v, ball, r, ring) in the balls of ``pivots``; ``lines`` are (ball, least r, greatest r, rows) of balls that hold rows."""

    rows: DataFrame
    pivots: list[list[float]]
    lines: list[tuple[int, float, float, int]]
    distance: Distance

    def from_pivots(self, v: Column) -> Column:
        """The distances of a vector from all pivots, which are one constant of the plan."""
        return F.transform(F.from_json(F.lit(json.dumps(self.pivots)), "array<array<double>>"), lambda p: self.distance(v, p))

    def _lines(self) -> Column:
        return F.from_json(F.lit(json.dumps([dict(zip("blhn", x, strict=True)) for x in self.lines])), "array<struct<b:int,l:double,h:double,n:bigint>>")

    def placed(self, queries: DataFrame, id_col: str, features: str) -> DataFrame:
        """(query_id, q, ds): queries with their distances from the pivots."""
        q = _vectors(queries, id_col, features, ("query_id", "q"))
        return q.withColumn("ds", self.from_pivots(F.col("q")))

    @property
    def in_blocks(self) -> bool:
        return getattr(self.distance, "matrix", None) is not None

    def met(self, asked: DataFrame, work, rows: DataFrame | None = None, schema: str = pairs.PAIR) -> DataFrame:
        """What ``work`` finds for the queries (query_id, q, ball, d, reach) among the rows of their balls.

        Balls and the queries of each are cut into chunks, so every task is bounded.
        ``rows`` may be some of the rows, with more columns.
        """
        dims = len(self.pivots[0])
        wanted = {r.ball: r.n for r in asked.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).collect()}
        cuts = [(b, pairs.chunks(n, dims), pairs.chunks(wanted.get(b, 0), dims)) for b, _, _, n in self.lines]
        most = max(b for b, *_ in cuts) + 1
        of = {b: (x, y) for b, x, y in cuts}

        def cut(k: int) -> Column:
            listed = F.from_json(F.lit(json.dumps([of.get(i, (1, 1))[k] for i in range(most)])), "array<int>")
            return F.element_at(listed, F.col("ball") + 1)

        rows = self.rows if rows is None else rows
        rows = rows.drop("ring").select("*", pairs.part_of("id", cut(0)).alias("rc"), pairs.upto(cut(1)).alias("qc"))
        queries = asked.select("query_id", "q", "d", "reach", F.col("ball").alias("ball"), pairs.part_of("query_id", cut(1)).alias("qc"), pairs.upto(cut(0)).alias("rc"))
        return pairs.meet(rows, queries, ["ball", "rc", "qc"], sum(x * y for _, x, y in cuts), work, schema)

    def asked(self, placed: DataFrame, radius: Column) -> DataFrame:
        """(query_id, q, ball, d, reach): placed queries with the balls that may hold rows within the radius."""
        near = F.array_min("ds")

        def ball(x: Column) -> Column:
            d = F.element_at("ds", x["b"] + 1)
            reach = F.col("radius") + ROUNDING * (d + x["h"] + F.col("radius"))
            open_ = (d - x["h"] <= reach) & (x["l"] - d <= reach) & (d - near <= 2 * reach)
            return F.struct(open_.alias("open"), x["b"].alias("ball"), d.alias("d"), reach.alias("reach"))

        q = placed.withColumn("radius", radius)
        q = q.select("query_id", "q", F.explode(F.filter(F.transform(self._lines(), ball), lambda x: x["open"])).alias("b"))
        return q.select("query_id", "q", "b.ball", "b.d", "b.reach")

    def within(self, placed: DataFrame, radius: Column, k: int | None = None, r: float | None = None, keep_self: bool = True) -> DataFrame:
        """(query_id, id, distance): what ``candidates`` gives for a distance with a matrix form, worked out in blocks."""
        return self.met(self.asked(placed, radius), pairs.chosen(self.distance.matrix, k, r, keep_self, True)).withColumnRenamed("value", "distance")

    def nearest_within(self, placed: DataFrame, k: int, keep_self: bool) -> DataFrame:
        """(query_id, id, distance): for each query the k nearest of the balls that ``nearest_balls`` takes, and maybe more."""
        asked = placed.select("query_id", "q", F.explode(self._nearest(k + (not keep_self))).alias("ball"))
        asked = asked.select("query_id", "q", "ball", F.lit(0.0).alias("d"), F.lit(float("inf")).alias("reach"))
        return self.met(asked, pairs.chosen(self.distance.matrix, k, None, keep_self)).withColumnRenamed("value", "distance")

    def candidates(self, placed: DataFrame, radius: Column) -> DataFrame:
        """(query_id, q, id, v, radius): the pairs that the distances from pivots leave open."""
        near = F.array_min("ds")

        def ball(x: Column) -> Column:
            d = F.element_at("ds", x["b"] + 1)
            reach = F.col("radius") + ROUNDING * (d + x["h"] + F.col("radius"))
            # Ring numbers of the two ends; a ball whose rows are all on its pivot has one ring.
            at = lambda r: F.when(x["h"] > 0, F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(float(RINGS)), r * RINGS / x["h"])))).otherwise(F.lit(0)).cast("int")
            first, last = F.greatest(F.lit(0), at(d - reach)), F.least(F.lit(RINGS - 1), at(d + reach))
            open_ = (d - x["h"] <= reach) & (x["l"] - d <= reach) & (d - near <= 2 * reach) & (first <= last)
            return F.struct(open_.alias("open"), x["b"].alias("ball"), d.alias("d"), reach.alias("reach"), first.alias("first"), last.alias("last"))

        q = placed.withColumn("radius", radius)
        q = q.select("query_id", "q", "radius", F.explode(F.filter(F.transform(self._lines(), ball), lambda x: x["open"])).alias("b"))
        q = q.select("query_id", "q", "radius", "b.ball", "b.d", "b.reach", F.explode(F.sequence("b.first", "b.last")).alias("ring"))
        both = self.rows.join(q, ["ball", "ring"]).where(F.abs(F.col("d") - F.col("r")) <= F.col("reach"))
        return both.select("query_id", "q", "id", "v", "radius")

    def _nearest(self, k: int) -> Column:
        """The nearest balls of a placed query that hold k rows together."""
        ordered = F.array_sort(F.transform(self._lines(), lambda x: F.struct(F.element_at("ds", x["b"] + 1).alias("d"), x["b"].alias("b"), x["n"].alias("n"))))
        none = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<int>").alias("bs"))
        taken = F.aggregate(ordered, none, lambda a, x: F.when(a["n"] >= k, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), F.array_append(a["bs"], x["b"]).alias("bs"))))
        return taken["bs"]

    def nearest_balls(self, placed: DataFrame, k: int) -> DataFrame:
        """(query_id, q, id, v): each query with the rows of its nearest balls that hold k rows together."""
        return placed.select("query_id", "q", F.explode(self._nearest(k)).alias("ball")).join(self.rows, "ball").select("query_id", "q", "id", "v")


def balls(data: DataFrame, id_col: str = "id", features: str = "features", distance: Distance = euclidian, pivots: int | None = None) -> Balls:
    """The partition of ``data``; ``pivots`` defaults to about half the root of the number of rows.

    Rows of a null id, and those with a null, NaN or infinite component, take no
    part. Equal rows lie in one ring, rows of one id each have a place.
    """
    v = materialise(_vectors(data, id_col, features, ("id", "v")), "metric-rows")
    n, dims = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most = max(1, min(MAX_PIVOTS, PIVOT_VALUES // max(dims or 1, 1)))
    wanted = min(pivots or int(n**0.5 / 2) + 1, most)
    # A share of the hash's range that holds some times as many rows; equal rows have one hash, so they count once.
    h = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    some = v.where(h < max(1, int(min(1.0, 16 * wanted / max(n, 1)) * (1 << 30)))).select("v", h.alias("h")).distinct()
    chosen = [list(r.v) for r in some.orderBy("h", "v").limit(wanted).collect()] or [list(r.v) for r in v.select("v", h.alias("h")).orderBy("h", "v").limit(1).collect()]
    out = Balls(v, chosen, [], distance)
    if not chosen:
        return Balls(v.select("id", "v", F.lit(0).alias("ball"), F.lit(0.0).alias("r"), F.lit(0).alias("ring")), chosen, [], distance)
    least = F.array_min(F.transform(out.from_pivots(F.col("v")), lambda d, i: F.struct(d.alias("r"), i.alias("ball"))))
    placed = materialise(v.withColumn("b", least).select("id", "v", "b.ball", "b.r"), "metric-balls")
    lines = [(r.ball, r.l, r.h, r.n) for r in placed.groupBy("ball").agg(F.min("r").alias("l"), F.max("r").alias("h"), F.count(F.lit(1)).alias("n")).collect()]
    reach = {b: h for b, _, h, _ in lines}
    widest = F.element_at(F.from_json(F.lit(json.dumps([reach.get(i, 0.0) for i in range(len(chosen))])), "array<double>"), F.col("ball") + 1)
    ring = F.when(widest > 0, F.least(F.lit(RINGS - 1), F.floor(F.col("r") * RINGS / widest).cast("int"))).otherwise(F.lit(0)).cast("int")
    return Balls(placed.select("id", "v", "ball", "r", ring.alias("ring")), chosen, sorted(lines), distance)


def radius_join(data: Balls, queries: DataFrame, r: float, id_col: str = "id", features: str = "features") -> DataFrame:
    """(query_id, id, distance): all rows within r of each query, the bound included."""
    if r < 0:
        raise FindFailed("the radius should not be negative")
    if not data.lines:
        return data.rows.select(F.col("id").alias("query_id"), "id", F.col("r").alias("distance")).limit(0)
    if data.in_blocks:
        return data.within(data.placed(queries, id_col, features), F.lit(float(r)), r=r)
    found = data.candidates(data.placed(queries, id_col, features), F.lit(float(r)))
    return found.select("query_id", "id", data.distance(F.col("v"), F.col("q")).alias("distance")).where(F.col("distance") <= r)


def knn_join(data: Balls, queries: DataFrame, k: int, id_col: str = "id", features: str = "features", keep_self: bool = True) -> DataFrame:
    """(query_id, id, distance, rnk): the k nearest rows of each query, ties to the smaller id.

    The k-th distance within the query's nearest balls bounds the search in all others.
    """
    if k < 1:
        raise FindFailed("k should be at least 1")
    total = sum(n for *_, n in data.lines)
    if total < k + (not keep_self):
        raise FindFailed("k is larger than the number of rows")
    placed = materialise(data.placed(queries, id_col, features), "metric-queries")
    order = Window.partitionBy("query_id").orderBy("distance", "id")

    def best(found: DataFrame) -> DataFrame:
        if data.in_blocks:
            near = found
        else:
            found = found if keep_self else found.where("id <> query_id")
            near = found.select("query_id", "id", data.distance(F.col("v"), F.col("q")).alias("distance"))
        return near.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)

    # Rows of the query's own id may be many; then the bound is open and all balls are searched.
    first = data.nearest_within(placed, k, keep_self) if data.in_blocks else data.nearest_balls(placed, k + (not keep_self))
    bound = best(first).where(F.col("rnk") == k).select("query_id", F.col("distance").alias("bound"))
    bounded = placed.join(materialise(bound, "metric-bounds"), "query_id", "left")
    widest = max(h for _, _, h, _ in data.lines)
    reach = F.coalesce("bound", F.array_max("ds") + widest)
    return best(data.within(bounded, reach, k=k, keep_self=keep_self) if data.in_blocks else data.candidates(bounded, reach).drop("radius"))
