"""Connected components of a link table, by label propagation with pointer jumping. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetcast.session import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for each node of the links ``(a, b)``; the label is the smallest node that links reach.

    Each round takes the smallest label among neighbours, then the label of that label; tables are written between rounds,
    so lost executors cost one round. The number of rounds grows with the logarithm of the longest chain for usual graphs.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = materialize(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        stepped = materialize(lower.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        discard(lower, labels)
        labels = stepped
        if not stepped.filter("label <> old").head(1):
            discard(both)
            return stepped.select("node", "label")
