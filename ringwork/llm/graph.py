"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwork.runtime import written


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of each node of the edges (a, b), both long.

    Each round gives a node the smallest label among its neighbours' and then the label of its label, so the rounds grow with the logarithm of a
    component's width. Labels are aggregated before they are shuffled; a node with many edges is split by the join. Nothing but the number of
    changed labels comes to the driver. No edges: no rows.
    """
    both = edges.where("a <> b")
    both = written(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("offer"))
        lower = labels.join(offered, labels["node"] == offered["a"]).select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        lower = written(lower, "labels")
        there = lower.select(F.col("node").alias("at"), F.col("label").alias("next"))
        labels = written(lower.join(there, lower["label"] == there["at"]).select("node", "old", F.least("label", "next").alias("label")), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
