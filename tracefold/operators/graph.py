"""Rounds over a table of links: greedy choices by position, chains of redirects, cycles.

Each round is a few joins and a distinct over what is still open, written to the shared folder; the number of rounds grows
with the length of chains (greedy choices) or its logarithm (redirects), never with the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.shared import saved, swept


def greedy_first(rivals: DataFrame) -> DataFrame:
    """(id): the nodes that a walk in the order of positions does not choose, because a rival before them was chosen.

    rivals: (late, early), each pair once, the earlier node second; every node that is not returned is chosen. A round chooses
    the nodes all of whose earlier rivals are settled, and settles those that they rule out.
    """
    left = swept(rivals.select("late", "early").distinct(), "rivals")
    out = []
    while not left.isEmpty():
        chosen = left.select(F.col("early").alias("id")).distinct().join(left.select(F.col("late").alias("id")).distinct().hint("merge"), "id", "left_anti")
        ruled = swept(left.join(chosen.withColumnRenamed("id", "early").hint("merge"), "early", "left_semi").select(F.col("late").alias("id")).distinct(), "ruled")
        out.append(ruled)
        left = left.join(ruled.withColumnRenamed("id", "late").hint("merge"), "late", "left_anti").join(ruled.withColumnRenamed("id", "early").hint("merge"), "early", "left_anti")
        left = swept(left, "rivals")
    if not out:
        return rivals.select(F.col("late").alias("id")).limit(0)
    all_ruled = out[0]
    for x in out[1:]:
        all_ruled = all_ruled.unionByName(x)
    return all_ruled


def _jumped(redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((old, new) that end, (old, new) that never do, `new` then being somewhere on the circle)."""
    step = saved(redirects.where("old IS NOT NULL AND new IS NOT NULL").groupBy("old").agg(F.min("new").alias("new")), "redirects")
    longest, reach = step.count(), 1
    while reach <= longest:
        onward = step.select(F.col("old").alias("new"), F.col("new").alias("next"))
        jumped = step.join(onward, "new", "left").select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("moved"))
        jumped = saved(jumped, "redirects")
        step, reach = jumped.drop("moved"), reach * 2
        if jumped.where("moved").isEmpty():
            break
    # an end is nobody's old name
    endless = step.join(step.select(F.col("old").alias("new")), "new", "left_semi").select("old", "new")
    return step.join(endless.select("old"), "old", "left_anti"), endless


def closed_redirects(redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((old, new) with chains followed to their ends, (old) of those that run into a circle and so have no end).

    redirects: (old, new), one row for each old. Pointer jumping: a round doubles the length of all paths, so a chain of n
    takes log2(n) rounds; what is not at an end after as many rounds as could matter goes round in circles.
    """
    ends, endless = _jumped(redirects)
    return ends, endless.select("old")


def circles(parents: DataFrame) -> DataFrame:
    """(node): the nodes of (old, new), one parent each, that are their own ancestors.

    After as many steps as there are nodes everything endless stands on a circle, and every node of a circle is where one of
    them stands.
    """
    return _jumped(parents)[1].select(F.col("new").alias("node")).distinct()


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node): the nodes of a directed graph (from, to) that lie on a cycle or between two.

    Nodes that nothing leads to, or that lead to nothing, are taken away with their edges until none is left. What stays
    is empty for a graph without cycles; each round takes one layer from both ends.
    """
    left = saved(edges.where("from IS NOT NULL AND to IS NOT NULL").select("from", "to").distinct(), "edges")
    n = left.count()
    while n:
        inner = left.join(left.select(F.col("to").alias("from")).distinct(), "from", "left_semi").join(left.select(F.col("from").alias("to")).distinct(), "to", "left_semi")
        left = saved(inner.select("from", "to"), "edges")
        m = left.count()
        if m == n:
            break
        n = m
    return left.select(F.col("from").alias("node")).unionByName(left.select(F.col("to").alias("node"))).distinct()
