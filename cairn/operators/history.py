"""Training histories: best rows, trailing trends, early stopping, and per-vector statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_row(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_i = 1").drop("_i")


def strict_gains(rows: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    """Adds is_best: whether a step's value is above all before; the first step is. A tie is no gain."""
    before = F.max(value).over(W.partitionBy(*by).orderBy(step).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("is_best", before.isNull() | (F.col(value) > before))


def resumed(rows: DataFrame, starts: DataFrame, by: list[str], step: str, start: str = "start") -> DataFrame:
    """The steps that a resumed training keeps: those before its ``start``; a run that doesn't resume keeps all."""
    return rows.join(starts.groupBy(*by).agg(F.min(start).alias("_start")), by, "left").where(F.col("_start").isNull() | (F.col(step) < F.col("_start"))).select(*rows.columns)


def trailing(rows: DataFrame, by: list[str], step: str, value: str, size: int) -> DataFrame:
    """Adds change_<size> (first less last of the last rows) and slope_<size> (least squares; 0 for one row).

    Values are taken with four decimals and steps are whole, so sums are exact and only the last division rounds.
    """
    w = W.partitionBy(*by).orderBy(step).rowsBetween(1 - size, 0)
    x, z = F.col(step).cast("long"), F.round(F.col(value) * 10_000).cast("long")
    n, sx, sz, sxz, sxx = F.count("*").over(w), F.sum(x).over(w), F.sum(z).over(w), F.sum(x * z).over(w), F.sum(x * x).over(w)
    over = ((n * sxx - sx * sx) * 10_000).cast("decimal(20,0)")
    slope = F.when(over == 0, F.lit(0.0)).otherwise(((n * sxz - sx * sz).cast("decimal(18,0)") / over).cast("decimal(30,12)"))
    return rows.withColumn(f"change_{size}", (F.first(z).over(w) - z) / F.lit(10_000.0)).withColumn(f"slope_{size}", slope)


def deltas(rows: DataFrame, by: list[str], step: str, value: str) -> DataFrame:
    """Adds from_previous and from_best: the differences to the step before and to the least value before (null at the start)."""
    w = W.partitionBy(*by).orderBy(step)
    best = F.min(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumns({"from_previous": F.col(value) - F.lag(value).over(w), "from_best": F.col(value) - best})


#: Why a training ended.
PATIENCE, IMPROVING, PLATEAU = "convergence_patience_after_minimum_epochs", "reached_maximum_epoch_while_still_improving", "converged_or_plateaued_near_maximum_epoch"


def stop_reason(rows: DataFrame, by: list[str], step: str, value: str, minimum: int, patience: int, min_delta: float, size: int = 10) -> DataFrame:
    """(by, steps, best_step, best_value, reason): where and why a history of falling values ends.

    A step beyond the first ``minimum`` ones that isn't below all before by more than ``min_delta`` counts against
    ``patience``; one that is, starts the count anew. The history ends at the step that uses up the patience. One that
    never does ends with its last step: still improving if its last ``size`` values fell by more than ``min_delta`` with
    a falling slope, else a plateau. Steps after the end count for nothing. A run's steps are few.
    """
    w = W.partitionBy(*by).orderBy(step)
    until = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.select(*by, step, value, F.row_number().over(w).cast("long").alias("_i"), F.min(value).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    anew = F.col("_before").isNull() | (F.col(value) < F.col("_before") - min_delta) | (F.col("_i") <= minimum)
    counted = placed.withColumn("_since", F.col("_i") - F.max(F.when(anew, F.col("_i"))).over(until))
    spent = (F.col("_i") >= minimum) & (F.col("_since") >= patience)
    ended = counted.withColumn("_end", F.min(F.when(spent, F.col("_i"))).over(W.partitionBy(*by))).where(F.col("_end").isNull() | (F.col("_i") <= F.col("_end")))
    tailed = trailing(ended, by, "_i", value, size)
    last = lambda c: F.max_by(c, "_i")
    folded = tailed.groupBy(*by).agg(F.count("*").alias("steps"), F.min(F.struct(F.col(value).alias("v"), F.col(step).alias("s"))).alias("best"), F.max("_end").alias("end"), last(f"change_{size}").alias("change"), last(f"slope_{size}").alias("slope"))
    why = F.when(F.col("end").isNotNull(), PATIENCE).when((F.col("change") > min_delta) & (F.col("slope") < 0), IMPROVING).otherwise(PLATEAU)
    return folded.select(*by, "steps", F.col("best.s").alias("best_step"), F.col("best.v").alias("best_value"), why.alias("reason"))


def weighted_mean(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Mean of a value by its weights: sum of value times weight over the sum of weights; null where that is 0."""
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight).cast("double")).alias("weighted_mean"), F.sum(weight).alias("weight"))


def efficiency(rows: DataFrame, by: list[str], step: str, score: str, seconds: str, memory: str) -> DataFrame:
    """Training roll-up: steps, total seconds, largest memory, mean steps a second, and the step of the best score (of equals, the first)."""
    best = F.max_by(step, F.struct(F.col(score), -F.col(step))).alias("best_step")
    return rows.groupBy(*by).agg(F.count("*").alias("steps"), F.sum(seconds).alias("seconds"), F.max(memory).alias("memory"), F.avg(F.try_divide(F.lit(1.0), F.col(seconds))).alias("rate"), best, F.max(score).alias("best_score"))


def batch_metrics(rows: DataFrame, index: str, value: str, size: int) -> DataFrame:
    """(batch, first, last, n, mean, std) of consecutive batches of ``size`` rows by a whole-number index."""
    return rows.groupBy(F.floor(F.col(index) / size).alias("batch")).agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def early_stopping(rows: DataFrame, by: list[str], step: str, value: str, min_delta: float) -> DataFrame:
    """The reference value, which moves only on an improvement above ``min_delta``, and the steps since it moved.

    A history's steps are few; they are folded in order within one row.
    """
    steps = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).cast("double").alias("v")))).alias("h"))
    zero = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("since"))
    fold = F.aggregate("h", zero, lambda a, x: F.when(x["v"] > a["best"] + min_delta, F.struct(x["v"].alias("best"), F.lit(0).alias("since"))).otherwise(F.struct(a["best"].alias("best"), (a["since"] + 1).alias("since"))))
    return steps.select(*by, fold.alias("f")).select(*by, F.col("f.best").alias("reference"), F.col("f.since").cast("long").alias("steps_since"))
