"""A digest of many rows: a tree of hashes over rows in the order of a key, whatever their partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.graph import ensure_checkpoint_dir
from cairn.operators.relate import joined, numbered


def leaves(rows: DataFrame, by: list[str], order: list[str], text: Column, size: int = 64) -> DataFrame:
    """(by, node, hash): SHA-256 of each run of ``size`` rows of a group, their texts in order, each ended by a line feed.

    ``order`` tells rows apart; places are global, so leaves hold the same rows however the table is cut.
    """
    placed = numbered(rows.select(*by, *order, text.alias("_t")), by, order, "_place")
    node = (F.col("_place") / size).cast("long").alias("node")
    return placed.groupBy(*by, node).agg(F.array_sort(F.collect_list(F.struct("_place", "_t"))).alias("x")).select(*by, "node", F.sha2(F.concat(F.array_join(F.transform("x", lambda r: F.coalesce(r["_t"], F.lit(""))), "\n"), F.lit("\n")), 256).alias("hash"))


def root(nodes: DataFrame, by: list[str], size: int = 64) -> DataFrame:
    """(by, content_hash): each level hashes runs of ``size`` hashes of the level below, until a group has one node.

    Levels are as many as the logarithm of the number of leaves; each is written to the checkpoint folder.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    level = nodes.checkpoint()
    while not level.where("node > 0").isEmpty():
        # A group that is down to one node keeps it: a hash of one hash would make its digest depend on other groups.
        several = level.groupBy(*by).agg((F.max("node") > 0).alias("_several"))
        marked = joined(level, several, by)
        up = marked.groupBy(*by, (F.col("node") / size).cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("p"), "hash"))).alias("x"), F.first("_several").alias("_several"))
        below = F.array_join(F.transform("x", lambda r: r["hash"]), "\n")
        level = up.select(*by, "node", F.when(F.col("_several"), F.sha2(F.concat(below, F.lit("\n")), 256)).otherwise(below).alias("hash")).checkpoint()
    return level.select(*by, F.col("hash").alias("content_hash"))
