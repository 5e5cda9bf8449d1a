"""Connected components by alternating large-star and small-star steps.

Each step is a group minimum and a join on Spark; edges only, never a whole
component in one task.  Between the rounds the edges are checkpointed to the
shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import checkpointed


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, to a root."""
    ends = (edges.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root"))
            .unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root"))))
    odd = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("root").alias("root")).where("child + root > 1")
    return odd.isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, root)``, root = the component's least node.

    Only nodes with an edge to another node appear.  No edges: no rows.
    Repeated edges, loops and either direction are allowed; edges with a
    null end are ignored.
    """
    e = checkpointed(edges.where("a <> b")
                     .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(e):
        # Large star: every larger neighbour of a node goes to the node's least neighbour.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: every smaller neighbour of a node, and the node, go to the least one.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    # An edge goes from the larger node to the smaller, so a star's root is its least node.
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
