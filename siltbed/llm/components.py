"""Connected components of an edge table, by least labels and shortcuts, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm import base as b


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (x, y); comp is the component's least node.

    Each round takes the least label around every node and then the label's own label, which at least doubles
    how far a label is carried along a path of falling labels; no better bound on the rounds is claimed, and
    rounds go on until no label changes. Each round is a written table: nothing has to be computed again when executors go.
    Only labels that have moved themselves are looked up, so the one label of a giant component is not a join's hot key.
    """
    both = b.written(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    labels = b.written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("comp")).withColumnRenamed("x", "node"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        least = labels.join(around, labels.node == around.x, "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("new"))
        own = labels.where("node <> comp").select(F.col("node").alias("new"), F.col("comp").alias("up"))
        after = b.written(least.join(own, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("comp"), F.col("comp").alias("was")), "labels")
        labels = after.select("node", "comp")
        if not after.where("comp <> was").limit(1).count():
            return labels
