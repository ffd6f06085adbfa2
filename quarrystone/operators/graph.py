"""Connected components in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.sources.tables import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an undirected (a, b) edge list; the component is its smallest node.

    Each round lowers every node's label to the smallest label around it and then
    to the label of that label, so a chain of n nodes needs about log2(n) rounds.
    Labels are written out by reliable checkpoints and never collected.
    Aggregates combine on the map side, so one node may hold any share of the
    edges. An empty list gives an empty result.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # A node also lowers the label of the node it is labelled with.
        lowered = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("low"))
        offers = lowered.select("node", "low").union(lowered.select(F.col("label").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        jump = offers.select(F.col("node").alias("low"), F.col("low").alias("far"))
        new = cut(offers.join(jump, "low").select("node", F.least("low", "far").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old")).limit(1).count()
        labels = new
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
