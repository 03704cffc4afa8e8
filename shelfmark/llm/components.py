"""Connected components of an edge table by repeated minimum and pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import is_empty, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node of `edges` (a, b).

    A round lets each node take the smallest label among itself and its neighbours, then the label of that label.  Stars settle in
    one round and chains in a logarithmic number.  A hub's edges are summed map-side, and the join on it can be split.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while not is_empty(labels):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("new"))
        above = labels.select(F.col("node").alias("new"), F.col("label").alias("top"))
        moved = materialise(taken.join(above, "new").select("node", "label", F.least("new", "top").alias("new")), "labels")
        done = is_empty(moved.where("label != new"))
        labels = moved.select("node", F.col("new").alias("label"))
        if done:
            break
    return labels
