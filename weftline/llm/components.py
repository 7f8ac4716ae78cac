"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.session import materialise


#: With up to so many links, the least neighbours of their nodes are broadcast; beyond it both sides are shuffled.
BROADCAST_LINKS = 200_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One star step over edges (a > b), joined back through each node's least neighbour."""
    if large:
        links = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        links = edges
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = links.join(F.broadcast(least) if few else least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node that can be reached; isolated nodes are absent.

    Null ends and self-links are ignored, repeated links are harmless, and an
    empty table gives an empty table. Each pass is written to the shared folder,
    so lineage stays short and nothing is collected but two counters.
    """
    x, y = F.col(a), F.col(b)
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    e = materialise(e, "links")

    def state(d: DataFrame):
        return tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(e)
    while now[0]:
        few = now[0] <= BROADCAST_LINKS
        e = materialise(_star(_star(e, True, few), False, few), "links")
        before, now = now, state(e)
        if before == now:
            break
    labels = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
