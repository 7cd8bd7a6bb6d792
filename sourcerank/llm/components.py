"""Connected components of a link table by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): for each node of ``links`` (a, b), the smallest node it can reach.

    Each round takes the least label among a node's neighbours and then the label of that
    label, so chains shorten by more than half a round.  Labels are written once a round;
    the rounds end when none changes.  Links only reach the driver as a count.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = common.stored(both.distinct())
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = common.stored(labels)
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("best"))
        top = labels.select(F.col("node").alias("best"), F.col("label").alias("far"))
        after = common.stored(met.join(top, "best").select("node", F.col("label").alias("was"), F.least("best", "far").alias("label")))
        changed = after.filter("label <> was").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
