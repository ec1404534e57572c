"""Connected components of an edge table, by alternating large and small stars (joins and aggregates only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import staged


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root (the least node of its component), for every node that has an edge.

    Neither edges nor components pass through the driver; each round is written to the shared folder, and the number of
    rounds grows with the logarithm of the number of edges.
    """
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    seen = None
    while True:
        # large star: a node's larger neighbours join its least one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: a node's smaller neighbours, and the node, join the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "stars")
        sums = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == seen:
            break
        now, seen = new, sums
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
