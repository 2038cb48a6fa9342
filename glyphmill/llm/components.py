"""Connected components of an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.plans.lineage import cut
from glyphmill.plans.skew import split_join


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (large star) or smaller (small star) neighbours are tied to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")))
    tied = split_join(both, least, ["a"], "n")  # a hub's edges stay where they are
    if large:
        tied = tied.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return tied.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, first): of every node of `edges` (a, b), the smallest node it is linked to, directly or not, or is itself.

    Nodes are numbers or strings. Edges with a null end are left out. Rounds grow with the logarithm of the number of nodes; each node has at most one row per round. No edges, no rows.
    """
    now, before = cut(edges.filter("a <> b").select("a", "b").distinct()), None
    while True:
        now = cut(_star(_star(now, True), False))
        print_ = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_ == before:
            found = now.groupBy("a").agg(F.min("b").alias("first")).select(F.col("a").alias("node"), "first")
            return found.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("first")).distinct())
        before = print_
