"""Samples for review. Each has a limit by definition; ranks are cut in every task before rows meet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffled(rows: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """The first ``n`` rows by a hash of the key, in the order of the key."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return rows.orderBy(rank, key).limit(n).orderBy(key)


def gallery(rows: DataFrame, picked: DataFrame, by: list[str], key: str, rank: str = "pick") -> DataFrame:
    """(by, n, shown, first_pick) of groups of rows: how many there are, how many of them were picked, and the least rank among those."""
    return rows.join(picked.select(key, rank).dropDuplicates([key]), key, "left").groupBy(*by).agg(F.count("*").alias("n"), F.count(rank).alias("shown"), F.min(rank).alias("first_pick"))


def first_where(rows: DataFrame, condition: Column, order: list[str]) -> DataFrame:
    """The first row by ``order`` to which a condition applies, or none; each task hands on one row."""
    return rows.where(condition).orderBy(*order).limit(1)


def stratified(rows: DataFrame, by: list[str], key: str, n: int, seed: str = "42") -> DataFrame:
    """The first ``n`` rows of each group by a hash of the key, with their place as ``pick``."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return rows.withColumn("pick", F.row_number().over(W.partitionBy(*by).orderBy(rank, key))).where(F.col("pick") <= n)


def priority(rows: DataFrame, label: str, split: str, first: Column, key: str, per_label: int, most: int, seed: str = "42") -> DataFrame:
    """Up to ``per_label`` rows of each label and ``most`` in all: one of each split first, then those to which ``first`` applies, then by hash.

    Adds pick, the place within the label. Of all, lower places are taken first.
    """
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    late = F.when(first, 0).otherwise(1)
    ranked = rows.withColumns({"_rank": rank, "_late": late})
    heads = ranked.withColumn("_h", F.row_number().over(W.partitionBy(label, split).orderBy("_late", "_rank", key)))
    heads = heads.where(F.col("_h") <= per_label)
    taken = heads.withColumn("pick", F.row_number().over(W.partitionBy(label).orderBy(F.when(F.col("_h") == 1, 0).otherwise(1), "_late", "_rank", key)))
    return taken.where(F.col("pick") <= per_label).orderBy("pick", label).limit(most).drop("_rank", "_late", "_h")


def covering(rows: DataFrame, labels: str, key: str, count: int, classes: int, least: int = 8, seed: str = "42") -> DataFrame:
    """A sample of ``count`` rows with quotas by number of labels, chosen so that every class is covered ``least`` times.

    Numbers of labels share ``count`` evenly, smaller ones first. The next row is the one that mends most of what its
    classes lack, then that of most lacking classes, of most quota left, of the least covered classes, and of the
    least hash. Rows of one label set differ in the hash only, so Spark cuts each set to its first ``count`` rows, and
    the choice works on sets. Returns the rows with ``pick`` (from 1) and ``reason``, the classes that still lacked
    rows. Raises ValueError where a quota or the coverage can't be met.
    """
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    sets = rows.select(F.col(key), F.array_sort(labels).alias("_set"), rank.alias("_rank"))
    first = sets.withColumn("_n", F.row_number().over(W.partitionBy("_set").orderBy("_rank", key))).where(F.col("_n") <= count)
    pool = first.groupBy("_set").agg(F.array_sort(F.collect_list(F.struct("_rank", key))).alias("rows")).orderBy(F.size("_set"), "_set").collect()
    member = np.array([[c in set(p["_set"]) for c in range(classes)] for p in pool], np.int64).reshape(-1, classes)
    size, held = np.array([len(p["_set"]) for p in pool]), np.array([len(p["rows"]) for p in pool])
    sizes = np.unique(size)
    left = dict(zip(sizes.tolist(), (len(part) for part in np.array_split(np.arange(count), max(1, len(sizes))))))
    if not len(pool) or any(held[size == s].sum() < n for s, n in left.items()):
        raise ValueError(f"too few rows for the quotas {left}")
    used, covered, chosen, least = np.zeros(len(pool), np.int64), np.zeros(classes, np.int64), [], min(least, count)
    for pick in range(1, count + 1):
        lack = np.maximum(0, least - covered)
        open_quota = np.array([left[s] for s in size.tolist()])
        able = np.flatnonzero((used < held) & (open_quota > 0))
        heads = {int(k): pool[k]["rows"][used[k]] for k in able}
        order = sorted(able.tolist(), key=lambda k: (-int(member[k] @ lack), -int(member[k] @ (lack > 0)), -int(open_quota[k]), int(member[k] @ covered), heads[k]["_rank"]))
        k = order[0]
        chosen.append((heads[k][key], pick, "-".join(str(c) for c in range(classes) if member[k, c] and lack[c]) or "balanced"))
        used[k] += 1
        left[int(size[k])] -= 1
        covered += member[k]
    if covered.min() < least:
        raise ValueError(f"classes {np.flatnonzero(covered < least).tolist()} are covered fewer than {least} times")
    kind = rows.schema[key].dataType.simpleString()
    named = rows.sparkSession.createDataFrame(chosen, f"{key} {kind}, pick int, reason string")
    return rows.join(F.broadcast(named), key)
