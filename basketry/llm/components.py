"""Connected components of a graph given as edges, by label hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) for every node of an edge; root is the least node of its component.

    Every node has a label, a node of its component that is not larger; at first its least neighbour. In a round a node, and its label, take the least
    label of their neighbours' labels if that is less, and labels are followed one step. Rounds end when no label changes; that takes about the
    logarithm of the longest path. Each round is written, so lineage stays short, and no join reads an aggregation by its own key, so adaptive execution may
    split the edges of a hub over tasks.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = table(edges.filter("a <> b").select(F.inline(ways)).distinct())
    labels = table(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("f")).withColumnRenamed("a", "node"))
    while True:
        up = labels.select(F.col("node").alias("f"), F.col("f").alias("top"))
        at = labels.select("node", "f").join(up, "f").select("node", "f", "top")
        near = both.join(at.select(F.col("node").alias("b"), "top"), "b").groupBy("a").agg(F.min("top").alias("near"))
        found = at.join(near.withColumnRenamed("a", "node"), "node")
        least = F.least("top", "near")
        taken = found.select("node", least.alias("f"), F.col("f").alias("before")).unionByName(found.filter(F.col("near") < F.col("f")).select(F.col("f").alias("node"), F.col("near").alias("f"), F.lit(None).cast("long").alias("before")))
        labels = table(taken.groupBy("node").agg(F.min("f").alias("f"), F.max("before").alias("before")))
        if labels.filter("f < before").isEmpty():
            return labels.select("node", F.col("f").alias("root"))
