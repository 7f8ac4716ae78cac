"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.session import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component; (a, b) are the links.

    Labels spread to neighbours and then along label pointers, so the number of
    passes grows with the logarithm of the longest path. Each pass is written to
    the shared folder.
    """
    e = links.where("a <> b").select("a", "b")
    e = materialise(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(e.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).toDF("node", "label"), "labels")
    while True:
        spread = e.join(labels.toDF("b", "lb"), "b").groupBy("a").agg(F.min("lb").alias("near")).toDF("node", "near")
        hooked = labels.join(spread, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.toDF("label", "further")
        new = materialise(hooked.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
