"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """``links``: two long columns a, b. Returns (node, root) for every node that has a link: root is the component's least node.

    Alternates the large-star and small-star steps, which keep the number of links and end with one star for each component.
    Links stay distributed; every round cuts its lineage in reliable storage, and joins on hot nodes are plain equi-joins that
    adaptive execution can split.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = checkpoint(edges)
    while True:  # every round shortens the longest path
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows).distinct()
        after = checkpoint(small)
        parents = after.select(F.col("v").alias("u")).distinct()
        # done when all links go from a leaf to its root: nobody has two parents, and no parent has one
        unfinished = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").union(after.join(parents, "u", "left_semi").select("u")).limit(1).count()
        edges = after
        if not unfinished:
            return stars(edges)


def stars(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
