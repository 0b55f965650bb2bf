"""Connected components of an edge list, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.storage import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) for every end of edges (a long, b long).

    Each round takes the smallest label among neighbours, then follows the label's own label, so a path of n edges
    needs about log n rounds. Only minima are aggregated, which combine before the shuffle: a node with very many
    neighbours costs its task one row for each map task.
    """
    both = stored(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    table = labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("of")).agg(F.min("label").alias("near"))
        met = labels.join(near, F.col("node") == F.col("of"), "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        met = stored(met)
        jump = met.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = stored(met.join(jump, F.col("label") == F.col("via"), "left").select("node", "was", F.least("label", "far").alias("label")))
        forget(met, table)
        table, labels = new, new.select("node", "label")
        if not new.where("was <> label").limit(1).count():
            forget(both)
            return labels
