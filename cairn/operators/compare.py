"""Comparisons of models, reports, named checks: long tables of (metric, value) in, one row a finding out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIE = 1e-12


def long_metrics(wide: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, metric, value) of a table with a column for each metric."""
    keys = keys or []
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(keys, names, "metric", "value")


def versus(first: DataFrame, second: DataFrame, keys: list[str], names: tuple[str, str], lower_better: tuple[str, ...] = ()) -> DataFrame:
    """Each metric of two models: both values, second less first, that in percent of the first, and which one is better.

    A difference of TIE or less is a tie. The percentage is null where the first value is 0.
    """
    a, b = (x.select(*keys, "metric", F.col("value").alias(n)) for x, n in zip((first, second), names))
    out = a.join(b, [*keys, "metric"]).withColumn("difference", F.col(names[1]) - F.col(names[0]))
    gain = F.when(F.col("metric").isin(list(lower_better)), -F.col("difference")).otherwise(F.col("difference"))
    better = F.when(F.abs("difference") <= TIE, "tie").when(gain > 0, names[1]).otherwise(names[0])
    return out.withColumns({"relative_percent": F.try_divide(100 * F.col("difference"), F.col(names[0])), "better": better})


def best_of(models: dict[str, DataFrame], keys: list[str], lower_better: tuple[str, ...] = ()) -> DataFrame:
    """Each metric of several models side by side, and the names of the best ones (those within TIE of the best, by name)."""
    out = None
    for name, rows in models.items():
        one = rows.select(*keys, "metric", F.col("value").alias(name))
        out = one if out is None else out.join(one, [*keys, "metric"])
    names = sorted(models)
    top = F.when(F.col("metric").isin(list(lower_better)), F.least(*names)).otherwise(F.greatest(*names))
    best = F.array_compact(F.array(*(F.when(F.abs(F.col(n) - top) <= TIE, F.lit(n)) for n in names)))
    return out.withColumn("best", F.array_join(best, ";"))


def integrity(reported: DataFrame, recomputed: DataFrame, tolerance: float) -> DataFrame:
    """(metric, reported, recomputed, difference, holds) of every metric of either side; one that a side lacks doesn't hold."""
    a, b = reported.select("metric", F.col("value").alias("reported")), recomputed.select("metric", F.col("value").alias("recomputed"))
    out = a.join(b, "metric", "full_outer").withColumn("difference", F.abs(F.col("reported") - F.col("recomputed")))
    return out.withColumn("holds", F.coalesce(F.col("difference") <= tolerance, F.lit(False)))


def report(classes: DataFrame, overall: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support): a row for each class, then accuracy, macro avg and weighted avg; blanks are null."""
    rows = classes.select(F.col("class_id").cast("string").alias("label"), "precision", "recall", "f1", "support")
    n = F.sum("support")
    weighted = [(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in ("precision", "recall", "f1")]
    blank = F.lit(None).cast("double")
    middle = classes.agg(F.lit("macro avg").alias("label"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), n.alias("support"))
    last = classes.agg(F.lit("weighted avg").alias("label"), *weighted, n.alias("support"))
    accuracy = overall.select(F.lit("accuracy").alias("label"), blank.alias("precision"), blank.alias("recall"), F.col("accuracy").alias("f1"), F.lit(None).cast("long").alias("support"))
    return rows.unionByName(accuracy).unionByName(middle).unionByName(last)


def cells(confusion: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """The named cells of a confusion table, with their share of the true class."""
    spark = confusion.sparkSession
    named = spark.createDataFrame(wanted, "truth int, predicted int")
    support = confusion.groupBy("truth").agg(F.sum("n").alias("support"))
    return named.join(confusion, ["truth", "predicted"]).join(support, "truth").select("truth", "predicted", "n", F.try_divide(F.col("n").cast("double"), F.col("support").cast("double")).alias("share"))


def predicates(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(predicate, n, percent) of each named condition over all rows, from one scan."""
    one = rows.agg(F.count("*").alias("_total"), *(F.count_if(c).alias(k) for k, c in named.items()))
    out = one.unpivot("_total", list(named), "predicate", "n")
    return out.select("predicate", "n", F.try_divide(100.0 * F.col("n"), F.col("_total")).alias("percent"))


def checks(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(check, passed) of named aggregates over all rows, from one scan; null counts as failed."""
    one = rows.agg(*(F.coalesce(c, F.lit(False)).alias(k) for k, c in named.items()))
    return one.unpivot([], list(named), "check", "passed")


def gate(checked: DataFrame) -> DataFrame:
    """One row: PASS where all checks passed, else FAIL; how many there are, and the names of those that failed."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check"))))
    return checked.agg(F.count("*").alias("checks"), F.size(failed).cast("long").alias("failed"), F.array_join(failed, ";").alias("names")).withColumn("status", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))


def conclusion(low: Column, high: Column, gain: Column) -> Column:
    """What a difference and its interval support: supported_gain, supported_loss, or inconclusive with the direction seen."""
    seen = F.when(F.abs(gain) <= TIE, "equal").when(gain > 0, "inconclusive_gain").otherwise("inconclusive_loss")
    return F.when(low > 0, "supported_gain").when(high < 0, "supported_loss").otherwise(seen)


def matrix_cells(wide: DataFrame, truth: str, prefix: str = "predicted_class_") -> DataFrame:
    """(truth, predicted, n) of a table with a row for each true class and a column for each predicted one."""
    names = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot(truth, names, "_name", "_n")
    return long.select(F.col(truth).cast("int").alias("truth"), F.substring(F.col("_name"), len(prefix) + 1, 20).cast("int").alias("predicted"), F.col("_n").cast("long").alias("n"))


def matrix_rows(confusion: DataFrame, classes: list[int], prefix: str = "predicted_class_") -> DataFrame:
    """A row for each true class of (truth, predicted, n) and a column for each of ``classes``; absent cells are 0."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col("predicted") == c, F.col("n"))), F.lit(0))
    return confusion.groupBy("truth").agg(*(n(c).alias(f"{prefix}{c}") for c in classes))


def match_kind(truth: Column, predicted: Column) -> Column:
    """exact, partial or miss: how an array of predicted classes meets that of the true ones; null where either is."""
    common = F.size(F.array_intersect(truth, predicted))
    exact = (F.size(F.array_except(truth, predicted)) == 0) & (F.size(F.array_except(predicted, truth)) == 0)
    return F.when(truth.isNull() | predicted.isNull(), None).when(exact, "exact").when(common > 0, "partial").otherwise("miss")
