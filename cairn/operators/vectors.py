"""Audits of vector columns: statistics, alignment of pairs, closeness. A vector is one row; nothing is exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.validate import first_violation


def _fold(v: Column, f) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x.cast("double")))


def _odd(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def statistics(rows: DataFrame, vector: str, by: str) -> DataFrame:
    """Statistics of the finite components by class, and over all rows (``by`` null, overall true).

    Columns: vectors, components, not_finite, zero_norm, low, high, mean, std (of the population, from sums of squares,
    not below 0), mean_norm, max_norm. A vector with a component that isn't finite has no norm.
    """
    v = F.col(vector)
    finite = F.filter(v, lambda x: ~_odd(x))
    norm = F.when(F.size(finite) == F.size(v), F.sqrt(_fold(v, lambda x: x * x)))
    one = rows.select(F.col(by), F.size(v).alias("n"), F.size(finite).alias("f"), F.array_min(finite).cast("double").alias("low"), F.array_max(finite).cast("double").alias("high"), _fold(finite, lambda x: x).alias("s"), _fold(finite, lambda x: x * x).alias("q"), norm.alias("norm"))
    kinds = one.groupingSets([[by], []], by) if by else one.groupBy()
    mean = F.try_divide(F.sum("s"), F.sum("f").cast("double"))
    out = kinds.agg(F.grouping_id().alias("_g"), F.count("*").alias("vectors"), F.sum("n").alias("components"), F.sum(F.col("n") - F.col("f")).alias("not_finite"), F.count_if(F.col("norm") == 0).alias("zero_norm"), F.min("low").alias("low"), F.max("high").alias("high"), mean.alias("mean"), F.try_divide(F.sum("q"), F.sum("f").cast("double")).alias("_square"), F.avg("norm").alias("mean_norm"), F.max("norm").alias("max_norm"))
    return out.withColumn("std", F.sqrt(F.greatest(F.col("_square") - F.col("mean") * F.col("mean"), F.lit(0.0)))).withColumn("overall", F.col("_g") > 0).drop("_g", "_square")


def pair(a: Column, b: Column) -> dict[str, Column]:
    """mse, cosine (null for a zero vector), and mse of the vectors brought to length 1, of two vectors of one row."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    norm = F.sqrt(_fold(a, lambda x: x * x)) * F.sqrt(_fold(b, lambda x: x * x))
    cosine = F.try_divide(dot, norm)
    return {"mse": F.try_divide(gap, F.size(a).cast("double")), "cosine": cosine, "normalised_mse": F.try_divide(2 - 2 * cosine, F.size(a).cast("double"))}


def alignment(rows: DataFrame, position: str, a: str, b: str) -> DataFrame:
    """By position: pairs, mean mse and cosine, and how many vectors of either side are zero or not finite."""
    p = pair(F.col(a), F.col(b))
    odd = F.exists(a, _odd) | F.exists(b, _odd)
    zero = F.forall(a, lambda x: x == 0) | F.forall(b, lambda x: x == 0)
    one = rows.select(position, odd.alias("odd"), zero.alias("zero"), *(v.alias(k) for k, v in p.items()))
    return one.groupBy(position).agg(F.count("*").alias("pairs"), F.avg(F.when(~F.col("odd"), F.col("mse"))).alias("mse"), F.avg(F.when(~F.col("odd"), F.col("cosine"))).alias("cosine"), F.count_if("odd").alias("not_finite"), F.count_if("zero").alias("zero"))


def allclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-6) -> dict[str, Column]:
    """close (of equal length, and each component within atol + rtol |b|), max_difference and mean_difference of two vectors of one row."""
    x, y = (F.transform(v, lambda c: c.cast("double")) for v in (a, b))
    within = F.zip_with(x, y, lambda p, q: F.abs(p - q) <= atol + rtol * F.abs(q))
    gaps = F.zip_with(x, y, lambda p, q: F.abs(p - q))
    return {"close": (F.size(a) == F.size(b)) & F.forall(within, lambda c: F.coalesce(c, F.lit(False))), "max_difference": F.array_max(gaps), "mean_difference": F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda s, c: s + c), F.size(a).cast("double"))}


def cache_check(rows: DataFrame, index: str, vector: str, expected: int, dimension: int) -> DataFrame:
    """One row about a stored table of vectors, whose indices should be 0 .. expected - 1, once each.

    Columns: rows, unique_indices, missing, duplicates (rows beyond the first of an index), out_of_range, bad_shape,
    not_finite (vectors), zero_norm, status (PASS where all of the faults are 0). A null vector has a bad shape.
    """
    v = F.col(vector)
    whole = F.coalesce(F.size(v) == dimension, F.lit(False)) & v.isNotNull()
    one = rows.select(F.col(index).alias("i"), (~whole).alias("shape"), (whole & F.exists(v, lambda x: x.isNull() | _odd(x))).alias("odd"), (whole & F.forall(v, lambda x: x == 0)).alias("zero"))
    by_index = one.groupBy("i").agg(F.count("*").alias("c"), *(F.count_if(c).alias(c) for c in ("shape", "odd", "zero")))
    inside = F.coalesce(F.col("i").between(0, expected - 1), F.lit(False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    faults = {"missing": expected - F.count_if(inside), "duplicates": total(F.col("c") - 1), "out_of_range": total(F.when(~inside, F.col("c"))), "bad_shape": total("shape"), "not_finite": total("odd"), "zero_norm": total("zero")}
    out = by_index.agg(total("c").alias("rows"), F.count("i").alias("unique_indices"), *(c.alias(k) for k, c in faults.items()))
    sound = F.lit(True)
    for k in faults:
        sound = sound & (F.col(k) == 0)
    return out.withColumn("status", F.when(sound, "PASS").otherwise("FAIL"))


def shard_reason(rows: DataFrame, index: str, vector: str, expected: int, dimension: int, provenance: dict[str, str]) -> DataFrame:
    """Rows of stored shards with ``reason``, the first fault that keeps a row from being taken over; empty for none.

    Faults: provenance (a column of it differs from its value or is null), out_of_range, bad_shape, not_finite,
    zero_norm, duplicate (an index that several rows without another fault have: none of them is taken).
    """
    v, foreign = F.col(vector), F.lit(False)
    for name, value in provenance.items():
        foreign = foreign | ~F.col(name).eqNullSafe(F.lit(value))
    rules = {"provenance": foreign, "out_of_range": ~F.coalesce(F.col(index).between(0, expected - 1), F.lit(False)), "bad_shape": ~F.coalesce(F.size(v) == dimension, F.lit(False)), "not_finite": F.exists(v, lambda x: x.isNull() | _odd(x)), "zero_norm": F.forall(v, lambda x: x == 0)}
    checked = rows.withColumn("reason", first_violation(rules))
    several = checked.where("reason = ''").groupBy(index).agg(F.count("*").alias("_c")).where("_c > 1").select(index, F.lit(True).alias("_several"))
    out = checked.join(several, index, "left")
    return out.withColumn("reason", F.when((F.col("reason") == "") & F.col("_several"), "duplicate").otherwise(F.col("reason"))).drop("_several")


def still_to_do(wanted: DataFrame, judged: DataFrame, index: str) -> DataFrame:
    """The wanted rows whose index no sound row of ``judged`` (by shard_reason) has."""
    return wanted.join(judged.where("reason = ''").select(index), index, "left_anti")
