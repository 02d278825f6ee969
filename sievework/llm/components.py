"""Connected components of links between documents, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, component) for every end of a link, ``component`` being the smallest node reachable.

    ``links`` has two long columns, a and b.  Large-star and small-star steps alternate until nothing
    changes; a node of many links is only ever counted and joined, never gathered.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), label)
    while True:
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the least of the neighbourhood
        large = (ends.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        # small star: smaller neighbours, and the node itself, go to the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(small_least, "u")
        small = (pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        after = materialize(small, label)
        if (edges.count() == after.count() and edges.join(after, ["u", "v"], "left_anti").isEmpty()):
            break
        edges = after
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        edges.groupBy("v").agg(F.min("v").alias("component")).select(F.col("v").alias("node"), "component"))
