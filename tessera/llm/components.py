"""Connected components of an edge table, by spreading the smallest label and jumping along it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, stash


def components(edges: DataFrame) -> DataFrame:
    """node, label from edges (a, b): the smallest node that each node can reach.

    Each round every node takes the smallest label among itself and its neighbours, then the label
    of that label. Sums and joins only; every round's table is written, so the plan stays short, and
    the one before it is deleted. Nodes with very many neighbours and labels that very many nodes
    have are looked up where the rows are.
    """
    both = stash(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).where("node != other").distinct())
    moved = stash(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")))
    while True:
        labels = moved.select("node", "label")
        near = hot_join(both, labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        stepped = stash(labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("mid")))
        jumps = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        old, moved = moved, stash(hot_join(stepped, jumps, "mid", "left").select("node", "before", F.least("mid", F.coalesce("far", "mid")).alias("label")))
        discard(old, stepped)
        if moved.where("label != before").isEmpty():
            discard(both)
            return moved.select("node", "label")
