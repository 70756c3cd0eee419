"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollweave.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """node, label of every node with a link: label is the smallest node it can reach.

    links: a, b (long). Every round each node takes the smallest label among its neighbours' and then the
    label of that label, so long chains shorten by halves; each round is a table in the shared folder.
    """
    edges = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_near")), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        parents = labels.select(F.col("node").alias("_new"), F.col("label").alias("_up"))
        after = saved(hooked.join(parents, "_new", "left").select(
            "node", F.least("_new", F.coalesce("_up", "_new")).alias("label"), "_old"), "labels")
        labels = after.select("node", "label")
        if after.where("label <> _old").isEmpty():
            return labels
