"""Groups of things that share a key: connected components without collecting edges."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder that the cluster names. In local mode, where none is named, take a local one; elsewhere refuse."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "cairn-checkpoints"))


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared checkpoint folder as a table and read again; lineage ends there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ends(pointers: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): where the pointers (node, root) of each node end, at one that points at itself. Each round doubles the steps."""
    for _ in range(rounds):
        far = pointers.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = stored(pointers.join(far, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
        pointers = after.select("node", "root")
        if after.where("moved").isEmpty():
            return pointers
    raise RuntimeError(f"pointers still move after {rounds} rounds")


def shared_key_components(rows: DataFrame, node: str, key: str, rounds: int = 50) -> DataFrame:
    """(node, root): nodes that are joined by equal keys, directly or through others; the root is the smallest one.

    In each round every node points at the smallest one among those that share a key with it, and pointers are followed
    to their ends. The next round goes on with these ends in place of the nodes, each once a key, until no key holds
    several. So the pairs of nodes and keys are read whole in the first round only, and a key of n nodes costs n rows.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    pairs = stored(rows.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(key).alias("key")))
    labels, held = pairs.select("node").distinct().withColumn("root", F.col("node")), pairs.where("key IS NOT NULL")
    for _ in range(rounds):
        least = held.groupBy("key").agg(F.min("node").alias("root"), F.max("node").alias("most")).where("root < most").drop("most")
        pointers = stored(held.join(least, "key").groupBy("node").agg(F.min("root").alias("root")))
        if pointers.isEmpty():
            return labels
        found = ends(pointers)
        labels = labels.join(found.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.coalesce("far", "root").alias("root"))
        held = stored(held.join(found, "node").select(F.col("root").alias("node"), "key").distinct())
    raise RuntimeError(f"keys still hold several nodes after {rounds} rounds")
