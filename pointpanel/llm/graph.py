"""Connected components of an edge table by alternating star contraction, one written table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointpanel.session import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node at the smallest of them: those above the node (large star) or those below it (small)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(id, component) of every node of the edges (a, b), long ids: the smallest id that links reach. Self edges and nulls are ignored.

    The rounds grow with the logarithm of the longest path; each leaves a star forest that is smaller or nearer its end.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(ordered.distinct(), label)
    sign = None
    while True:
        now = stored(_star(_star(now, large=True), large=False), label)
        # A node with two parents or a parent that has one itself is still to be contracted.
        found = now.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        if (found["n"], found["s"]) == sign:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        sign = (found["n"], found["s"])
