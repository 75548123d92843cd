"""Moments that merge: count, mean, sum of squared deviations, least and greatest, from rows or from other moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.relate import joined
from cairn.operators.vectors import pair

MOMENTS = ("n", "mean", "m2", "low", "high")


def of(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, m2, low, high) of the finite values of a column; groups without one have n = 0 and nulls."""
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value).cast("double"))
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high"))


def merge(moments: DataFrame, by: list[str]) -> DataFrame:
    """The moments of coarser groups from those of finer ones, weighted by their counts.

    Deviations of the parts' means are taken from the common mean, so nothing cancels: groups are summed once for the
    mean, and their parts meet it again by the group's columns.
    """
    weight = F.sum("n").cast("double")
    whole = moments.groupBy(*by).agg(F.sum("n").alias("_n"), F.try_divide(F.sum(F.col("mean") * F.col("n")), weight).alias("_mean"))
    met = joined(moments, whole, by)
    off = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    return met.groupBy(*by).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(off).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"))


def deviation() -> Column:
    """The standard deviation of the population from n and m2."""
    return F.sqrt(F.try_divide(F.col("m2"), F.col("n").cast("double")))


def patches(rows: DataFrame, keep: list[str], a: str, b: str, width: int) -> DataFrame:
    """(keep, position, mse, cosine, odd): one row for each stretch of ``width`` components of two vectors of equal length.

    ``odd`` marks stretches with a component that isn't finite, or with vectors of unequal length; their numbers are null.
    """
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1, F.lit(width)), lambda i: F.struct((i / width).cast("int").alias("position"), F.slice(a, i + 1, F.lit(width)).alias("x"), F.slice(b, i + 1, F.lit(width)).alias("y")))
    each = rows.where((F.size(a) > 0) | (F.size(b) > 0)).select(*keep, F.inline(cut))
    bad = lambda v: F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    odd = (F.size("x") != F.size("y")) | bad("x") | bad("y")
    found = pair(F.col("x"), F.col("y"))
    return each.select(*keep, "position", *(F.when(~odd, found[k]).alias(k) for k in ("mse", "cosine")), odd.alias("odd"))


def by_position(rows: DataFrame) -> DataFrame:
    """By position of ``patches``: pairs, mean mse, the cosine's mean, least and greatest, how many are odd, and whether all is sound.

    Sound: no odd pair, and no cosine outside -1 to 1 by more than rounding or absent (a zero vector).
    """
    out = rows.groupBy("position").agg(F.count("*").alias("pairs"), F.avg("mse").alias("mse"), F.avg("cosine").alias("cosine_mean"), F.min("cosine").alias("cosine_min"), F.max("cosine").alias("cosine_max"), F.count_if("odd").alias("odd"), F.count("cosine").alias("_c"))
    sound = (F.col("_c") == F.col("pairs")) & (F.col("cosine_min") >= -1 - 1e-9) & (F.col("cosine_max") <= 1 + 1e-9)
    return out.withColumn("status", F.when(sound, "PASS").otherwise("FAIL")).drop("_c")


def epoch_rollup(rows: DataFrame, epoch: str, phase: str, image: str) -> DataFrame:
    """(epoch, phase, images, patches, cosine_mean, cosine_std, cosine_min, cosine_max, image_mean_min, mse, odd) of ``patches``.

    Images are the unit of the least mean: each image's mean cosine over its positions; all other numbers weigh patches.
    """
    own = of(rows, [epoch, phase, image], "cosine")
    sums = rows.groupBy(epoch, phase).agg(F.count("*").alias("patches"), F.avg("mse").alias("mse"), F.count_if("odd").alias("odd"))
    whole = merge(own, [epoch, phase]).withColumn("cosine_std", deviation())
    images = own.groupBy(epoch, phase).agg(F.count("*").alias("images"), F.min("mean").alias("image_mean_min"))
    out = sums.join(images, [epoch, phase]).join(whole, [epoch, phase])
    return out.select(epoch, phase, "images", "patches", F.col("mean").alias("cosine_mean"), "cosine_std", F.col("low").alias("cosine_min"), F.col("high").alias("cosine_max"), "image_mean_min", "mse", "odd")
