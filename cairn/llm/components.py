"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that is reachable from each node of links (a, b).

    Each round takes the least label among a node and its neighbours, then the label of that label; labels are written
    to the checkpoint folder, so the plan doesn't grow. Nothing but one count a round reaches the driver.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    both = both.checkpoint()
    labels = both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("root")).checkpoint()
    for _ in range(rounds):
        offers = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "root")
        best = offers.unionByName(labels).groupBy("node").agg(F.min("root").alias("root"))
        jump = best.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = best.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root")).checkpoint()
        changed = after.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        labels = after
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
