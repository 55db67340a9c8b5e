"""Connected components of a distributed edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.store import dropped, written

ROWS_PER_FILE = 1 << 21


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over (a, b), for every node with an edge.

    Each round takes the smallest label among the neighbours (a partial aggregate, so that a hub isn't gathered) and then
    follows labels of labels; the number of rounds follows the logarithm of the longest chain. Rounds end when no
    label changes. Each round's labels are written to the shared folder, which cuts lineage: a round reads the labels before
    it four times, so that plans would grow by that factor with every round.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges"
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    old, rows = None, 0
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lowered = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        rows = rows or labels.count()
        step = written(lowered.coalesce(-(-rows // ROWS_PER_FILE) or 1), "cc-step")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = step.join(jump, "component").select("node", "was", F.least("component", "further").alias("component"))
        after = written(after.coalesce(-(-rows // ROWS_PER_FILE) or 1), "cc-labels")
        changed = after.where("component <> was").limit(1).count()
        labels = after.select("node", "component")
        dropped(step)
        if old is not None:
            dropped(old)
        old = after
        if not changed:
            dropped(both)
            return labels
