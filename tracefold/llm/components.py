"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import discard, materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Each round points every node at its smallest neighbour, shortens the paths twice, and replaces the ends of all edges by
    what they point at, until no edge is left. A round at least halves the nodes that still have edges. Each step is
    written to the shared folder.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = materialize(both(edges.where("a != b")).distinct(), "edges")
    roots = materialize(left.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "roots")
    while not left.isEmpty():
        up = materialize(left.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("up")), "up")
        for _ in range(2):
            over = up.select(F.col("a").alias("up"), F.col("up").alias("over"))
            longer, up = up, materialize(up.join(over, "up", "left").select("a", F.coalesce("over", "up").alias("up")), "up")
            discard(longer)
        old = [roots, left, up]
        roots = materialize(roots.join(up.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        ends = up.select(F.col("a").alias("b"), F.col("up").alias("b2"))
        moved = left.join(up, "a").drop("a").withColumnRenamed("up", "a").join(ends, "b").select("a", F.col("b2").alias("b"))
        left = materialize(moved.where("a != b").distinct(), "edges")
        discard(*old)
    return roots
