"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.storage import settle, settle_measured

#: Nodes in a file of a round's checkpoint; few nodes would otherwise make a file for each partition.
PER_FILE = 200_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(src, dst)``; root is the smallest node that it reaches.

    Each node has a label, at first itself. In a round it takes the least label of its neighbours, hands
    that on to the node it was labelled with, and then takes its label's own label, so that distances halve
    and long chains need few rounds. It ends when no label changes. Every round is checkpointed, its labels with their real size, as the
    planner's estimate would have twice the digits after each round. A node with many
    neighbours, and a label with many nodes, are only ever keys of a join with one row for them on the other side,
    which adaptive execution splits, or of a sum that starts before the shuffle. Nodes without an
    edge, and edges with a null end, are left out.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    e = settle(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = e.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label")).withColumnRenamed("src", "node")
    labels = settle(labels)
    files = max(1, labels.count() // PER_FILE)
    for _ in range(max_rounds):
        heard = e.join(labels.hint("merge"), F.col("src") == F.col("node")).groupBy("dst").agg(F.min("label").alias("heard"))
        told = labels.join(heard, F.col("node") == F.col("dst")).select("node", "label", F.least("label", "heard").alias("low"))
        passed = told.groupBy(F.col("label").alias("to")).agg(F.min("low").alias("passed"))
        low = told.join(passed, F.col("node") == F.col("to"), "left").select("node", F.col("label").alias("old"), F.least("low", "passed").alias("label"))
        low = settle(low.coalesce(files))
        above = low.select(F.col("node").alias("up"), F.col("label").alias("root"))
        labels = settle_measured(low.join(above, F.col("label") == F.col("up")).select("node", "old", F.col("root").alias("label")).coalesce(files))
        moved = labels.where("label <> old").limit(1).count()
        labels = labels.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
