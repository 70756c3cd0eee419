"""Connected components of a table of links between records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rollweave.session import stage


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` of every node with a link: component is the smallest node it can reach.

    ``links(a, b)``, of any type with an order. A round is a large star (every neighbour above a node is tied to the
    smallest node around) and a small star (the same for its lower neighbours), so the number of rounds is
    logarithmic. Minima are combined map-side, and a node is never held with its neighbours. Components that have become stars are set
    aside at once: a round reads and writes the others alone. Every round is a table in the shared folder.
    """
    tied = F.col("a") != F.col("b")
    edges = stage(links.where(tied).select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct(), "links")
    stars = []
    while True:
        edges = stage(_small_star(_large_star(edges)), "stars")
        told = stage(edges.join(_unsettled(edges).withColumn("_open", F.lit(True)), "parent", "left").select(
            "child", "parent", F.coalesce("_open", F.lit(False)).alias("open")), "settled")
        stars.append(told.where("NOT open").select("child", "parent"))
        edges = told.where("open").select("child", "parent")
        if edges.isEmpty():
            break
    ends = reduce(DataFrame.unionByName, stars)
    leaves = ends.select(F.col("child").alias("node"), F.col("parent").alias("component"))
    return leaves.unionByName(ends.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node, tied to the smallest of the node and its neighbours."""
    both = edges.select(F.col("child").alias("node"), F.col("parent").alias("near")).unionByName(
        edges.select(F.col("parent").alias("node"), F.col("child").alias("near")))
    least = both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("parent"))
    return both.where("near > node").join(least, "node").select(F.col("near").alias("child"), "parent").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lower neighbours, tied to the smallest of these."""
    least = edges.groupBy("child").agg(F.min("parent").alias("_least"))
    others = edges.join(least, "child").where("parent > _least").select(F.col("parent").alias("child"), F.col("_least").alias("parent"))
    return least.select("child", F.col("_least").alias("parent")).unionByName(others).distinct()


def _unsettled(edges: DataFrame) -> DataFrame:
    """The parents in components that are no star yet: those with a child that has children or further parents, and
    those that are children themselves."""
    parents = edges.select("parent").distinct()
    children = edges.groupBy("child").agg((F.count("*") > 1).alias("_several"))
    lower = parents.select(F.col("parent").alias("child"), F.lit(True).alias("_has"))
    told = edges.join(children, "child").join(lower, "child", "left").where("_several OR _has")
    return told.select("parent").unionByName(parents.join(edges.select(F.col("child").alias("parent")), "parent", "left_semi")).distinct()
