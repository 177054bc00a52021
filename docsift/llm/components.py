"""Connected components of an undirected graph by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docsift.llm.common import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node of the component.

    Each round takes the smallest label of all neighbours and then the label of the node so labelled. Minima are
    combined before every exchange and the joins are plain equi-joins, so a node with many edges is no hot task.
    Each round is written to the shared folder; an edge list with many copies of one edge is allowed.
    """
    both = stored(edges.select("a", "b").unionAll(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("near")).select(
        F.col("a").alias("node"), F.least("a", "near").alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", F.least("root", "near").alias("root"), F.col("root").alias("old")
        )
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = lower.join(jump, "root", "left").select(
            "node", F.least("root", F.coalesce("further", "root")).alias("root"), "old"
        )
        new = stored(new, "labels")
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
