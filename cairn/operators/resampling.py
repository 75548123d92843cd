"""Paired cluster bootstrap: sufficient counts of each cluster are joined with how often a replicate draws it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.cols import ratio
from cairn.operators.relate import numbered


def draws(spark, clusters: int, repetitions: int, seed: int) -> DataFrame:
    """(rep, cluster, times): replicates of ``clusters`` draws with replacement, from numpy's generator.

    Each replicate is generated in the task that holds it, from a seed of its own.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for rep in pdf["id"]:
                counts = np.bincount(np.random.default_rng([seed, int(rep)]).integers(0, clusters, clusters), minlength=clusters)
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"rep": int(rep), "cluster": at, "times": counts[at]})

    return spark.range(repetitions).mapInPandas(run, "rep long, cluster long, times long")


def accuracy_difference(rows: DataFrame, cluster: str, first: str, second: str, drawn: DataFrame) -> DataFrame:
    """Per replicate: the difference of the shares of true ``second`` and ``first`` flags. ``drawn`` numbers clusters by their order."""
    own = rows.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), F.sum(F.col(first).cast("long")).alias("a"), F.sum(F.col(second).cast("long")).alias("b"))
    joined = drawn.join(own, "cluster")
    total = F.sum(F.col("n") * F.col("times"))
    return joined.groupBy("rep").agg((ratio(F.sum(F.col("b") * F.col("times")), total) - ratio(F.sum(F.col("a") * F.col("times")), total)).alias("difference"))


METRICS = ("accuracy", "macro_f1", "weighted_f1", "macro_auroc")


def times_drawn(clusters: int, leaf: int, repetitions: int, seed: int, block: int, leaf_size: int = 4096) -> np.ndarray:
    """How often each replicate of a block (first axis) draws each cluster of a leaf, a run of ``leaf_size`` clusters.

    A replicate draws as many clusters as there are, with replacement. The draws of a range are dealt to its halves by a
    binomial, down to the leaves, each node with a generator of its own; so any task can work out its own leaf's counts,
    and all tasks agree, though none holds all clusters.
    """
    begin, end = 0, -(-clusters // leaf_size)
    size = lambda a, b: min(b * leaf_size, clusters) - a * leaf_size
    drawn = np.full(repetitions, clusters, np.int64)
    while end - begin > 1:
        middle = (begin + end) // 2
        left = np.random.default_rng([seed, block, begin, end]).binomial(drawn, size(begin, middle) / size(begin, end))
        begin, end, drawn = (begin, middle, left) if leaf < middle else (middle, end, drawn - left)
    n = size(begin, end)
    return np.random.default_rng([seed, block, begin, end, 1]).multinomial(drawn, np.full(n, 1 / n))


def _blocks(rows: DataFrame, repetitions: int, per_task: int) -> DataFrame:
    """Each row once for every ``per_task`` replicates, whose first one is ``_from``."""
    return rows.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(max(repetitions - 1, 0)), F.lit(per_task))))


def replicate_metrics(rows: DataFrame, models: dict[str, tuple[str, str]], classes: int, repetitions: int, seed: int, block: int = 250, per_task: int = 2500, leaf_size: int = 4096, rows_per_range: int = 20_000) -> DataFrame:
    """(rep, model, metric, value): METRICS of each model for replicates of the clusters; null where a class lacks a side.

    ``rows`` has cluster, truth, and for each model two columns: the predicted class and an array with a score a class.
    Counts that suffice are weighted by how often their cluster was drawn: of hits, support and calls, by leaves of
    clusters; and of positives and negatives by score, by ranges of the sorted scores, of which each gives its sums and
    the area inside, so a range needs nothing of the others. Equal scores are one step, also where ranges cut them. No
    task holds more than a leaf or a range, and the driver holds the number of clusters.
    """
    rows = rows.where(F.col("cluster").isNotNull())
    numbers = numbered(rows.select("cluster").distinct(), [], ["cluster"], "c").checkpoint()
    n = numbers.count()
    told = F.array(*(F.struct(F.lit(i).alias("m"), F.col(p).cast("int").alias("p"), F.col(s).alias("s")) for i, (p, s) in enumerate(models.values())))
    each = rows.select("cluster", F.col("truth").cast("int").alias("t"), F.inline(told))
    cells = each.groupBy("cluster", "m", "t", "p").agg(F.count("*").alias("n")).join(numbers, "cluster")

    def count(key: tuple, held: pa.Table) -> pa.Table:
        leaf, begin = key[0].as_py(), key[1].as_py()
        m, t, p, times, at = (np.asarray(held[x]) for x in ("m", "t", "p", "n", "c"))
        sums = np.zeros((min((leaf + 1) * leaf_size, n) - leaf * leaf_size, len(models), classes, 3))
        for what, k, own in ((0, t, t == p), (1, t, np.ones(len(t), bool)), (2, p, np.ones(len(t), bool))):
            np.add.at(sums, (at[own] - leaf * leaf_size, m[own], k[own], what), times[own])
        out = []
        for first in range(begin, min(begin + per_task, repetitions), block):
            size = min(block, repetitions - first)
            got = np.tensordot(times_drawn(n, leaf, size, seed, first // block, leaf_size).astype(float), sums, 1)
            r, i, k = np.indices(got.shape[:3]).reshape(3, -1)
            out.append(pa.table([r + first, i.astype(np.int32), k.astype(np.int32), *got.reshape(-1, 3).astype(np.int64).T], names=["rep", "m", "k", "tp", "support", "called"]))
        return pa.concat_tables(out)

    counted = _blocks(cells.withColumn("_leaf", F.floor(F.col("c") / leaf_size)), repetitions, per_task)
    counted = counted.groupBy("_leaf", "_from").applyInArrow(count, "rep long, m int, k int, tp long, support long, called long")
    counted = counted.groupBy("rep", "m", "k").agg(*(F.sum(x).alias(x) for x in ("tp", "support", "called")))
    f1, total = ratio(2 * F.col("tp"), F.col("support") + F.col("called")), F.sum("support")
    plain = counted.groupBy("rep", "m").agg(ratio(F.sum("tp"), total).alias("accuracy"), F.avg(f1).alias("macro_f1"), ratio(F.sum(f1 * F.col("support")), total).alias("weighted_f1"))

    scored = each.select("cluster", "m", "t", F.posexplode("s").alias("k", "score")).withColumn("score", F.col("score").cast("double"))
    scored = scored.groupBy("cluster", "m", "k", "score").agg(F.count_if(F.col("t") == F.col("k")).alias("pos"), F.count("*").alias("n")).join(numbers, "cluster").drop("cluster").checkpoint()
    ranges = max(1, -(-scored.count() // rows_per_range))
    ranged = scored.repartitionByRange(ranges, "m", "k", F.desc("score"), "c").withColumn("_range", F.spark_partition_id()).checkpoint()

    def area(key: tuple, held: pa.Table) -> pa.Table:
        held = held.sort_by([("m", "ascending"), ("k", "ascending"), ("score", "descending")])
        begin = key[1].as_py()
        m, k, score, pos, every, at = (np.asarray(held[x]) for x in ("m", "k", "score", "pos", "n", "c"))
        new = np.append(True, (m[1:] != m[:-1]) | (k[1:] != k[:-1]) | (score[1:] != score[:-1]))
        steps = np.flatnonzero(new)
        own = np.append(True, (m[steps][1:] != m[steps][:-1]) | (k[steps][1:] != k[steps][:-1]))
        begins = np.flatnonzero(own)
        ends = np.append(begins[1:], len(steps))
        leaves = at // leaf_size
        out = []
        for first in range(begin, min(begin + per_task, repetitions), block):
            size = min(block, repetitions - first)
            times = np.empty((size, len(at)))
            for leaf in np.unique(leaves):
                mine = leaves == leaf
                times[:, mine] = times_drawn(n, int(leaf), size, seed, first // block, leaf_size)[:, at[mine] - leaf * leaf_size]
            p = np.add.reduceat(times * pos, steps, axis=1)
            q = np.add.reduceat(times * (every - pos), steps, axis=1)
            for a, b in zip(begins, ends, strict=True):
                # The first and the last score may go on in other ranges: they are pieces of their own.
                for x, y in dict.fromkeys(((a, a + 1), (a + 1, b - 1), (b - 1, b))):
                    if y > x:
                        before = np.cumsum(p[:, x:y], axis=1) - p[:, x:y] / 2
                        inner = (q[:, x:y] * before).sum(1) if y - x > 1 else np.zeros(size)
                        same = lambda v, kind: np.full(size, v, kind)
                        out.append(pa.table([np.arange(first, first + size), same(m[steps[a]], np.int32), same(k[steps[a]], np.int32), same(score[steps[x]], float), same(score[steps[y - 1]], float), p[:, x:y].sum(1), q[:, x:y].sum(1), inner, same(y - x == 1, bool)], names=["rep", "m", "k", "high", "low", "pos", "neg", "inner", "one"]))
        return pa.concat_tables(out)

    pieces = _blocks(ranged, repetitions, per_task).groupBy("_range", "_from").applyInArrow(area, "rep long, m int, k int, high double, low double, pos double, neg double, inner double, one boolean")
    pieces = pieces.groupBy("rep", "m", "k", "high", "low", "one").agg(*(F.sum(x).alias(x) for x in ("pos", "neg", "inner")))
    before = F.coalesce(F.sum("pos").over(W.partitionBy("rep", "m", "k").orderBy(F.desc("high"), F.desc("low")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    areas = pieces.withColumn("area", F.when(F.col("one"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("inner")) + F.col("neg") * before)
    areas = areas.groupBy("rep", "m", "k").agg(F.try_divide(F.sum("area"), F.sum("pos") * F.sum("neg")).alias("a"))
    areas = areas.groupBy("rep", "m").agg(F.when(F.count("a") == classes, F.avg("a")).alias("macro_auroc"))
    named = F.get(F.array(*map(F.lit, models)), F.col("m")).alias("model")
    return plain.join(areas, ["rep", "m"]).unpivot(["rep", "m"], list(METRICS), "metric", "value").select("rep", named, "metric", "value")


def paired_differences(replicates: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(rep, pair, metric, difference): the second model's value less the first one's, in the same replicate."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("value")))
    values = F.array(*(F.struct(F.lit(f"{b}_minus_{a}").alias("pair"), (of(b) - of(a)).alias("difference")) for a, b in pairs))
    return replicates.groupBy("rep", "metric").agg(values.alias("x")).select("rep", "metric", F.inline("x"))


def summary(replicates: DataFrame, value: str = "difference", by: tuple[str, ...] = ()) -> DataFrame:
    v = F.col(value)
    ok = replicates.where(v.isNotNull() & ~F.isnan(v))
    return ok.groupBy(*by).agg(
        F.count("*").alias("valid"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("se"),
        F.percentile(v, F.lit(0.025)).alias("low"),
        F.percentile(v, F.lit(0.975)).alias("high"),
        F.avg((v > 0).cast("double")).alias("p_above"),
        F.avg((v < 0).cast("double")).alias("p_below"),
    ).withColumn("ci_includes_0", F.expr("low <= 0 AND high >= 0"))
