"""Validators of tables: rows that break rules, summaries with a status, ambiguous keys, probabilities, paths, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_violation(rules: dict[str, Column]) -> Column:
    """The name of the first rule that a row breaks, in the rules' order; empty for none. A rule that is null isn't broken."""
    out = F.lit("")
    for name, broken in reversed(rules.items()):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def cascade(rows: DataFrame, rules: dict[str, Column], kept: str = "kept") -> DataFrame:
    """(kind, n): how many rows the first rule that they break takes away, and how many are kept; kinds without rows are absent."""
    reason = first_violation(rules)
    return rows.groupBy(F.when(reason == "", kept).otherwise(reason).alias("kind")).agg(F.count("*").alias("n"))


def exclusions(parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """(key, reason) of the rows that any of some tables names, each pair once; a row may have several reasons."""
    out = None
    for reason, rows in parts.items():
        one = rows.select(*key, F.lit(reason).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def presence(rows: DataFrame, by: list[str], column: str, values: list[str], name: str = "has") -> DataFrame:
    """(by, <name>_<value> as 0 or 1.., rows, several): which values a group holds; ``several`` holds where there is more than one."""
    flags = [F.max(F.coalesce(F.col(column) == v, F.lit(False)).cast("int")).alias(f"{name}_{v}") for v in values]
    return rows.groupBy(*by).agg(*flags, F.count("*").alias("rows"), (F.countDistinct(column) > 1).alias("several"))


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, reason) for each rule that a row breaks; rows of one key report a reason once."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return rows.select(*key, F.explode(broken).alias("reason")).distinct()


def summary(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: the number of rows, that of rows that break each rule, and PASS where there are rows and none breaks one."""
    out = rows.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(name) for name, c in rules.items()))
    sound = F.col("rows") > 0
    for name in rules:
        sound = sound & (F.col(name) == 0)
    return out.withColumn("status", F.when(sound, "PASS").otherwise("FAIL"))


def ambiguous_keys(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that have several values: the key, the number of rows and that of distinct values, a null being one."""
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct(F.struct(value)).alias("values"))
    return out.where("values > 1")


def duplicate_excess(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, distinct values, n less those, values that repeat, and the rows beyond the first of each. Nulls don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    out = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("distinct_n"), F.count_if(F.col("c") > 1).alias("repeated"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("beyond_first"))
    return out.withColumn("excess", F.col("n") - F.col("distinct_n"))


def probability_reason(p: Column, tolerance: float = 1e-5) -> Column:
    """Why an array is no distribution: empty, not_finite, out_of_range, or bad_sum; empty text where it is one."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    rules = {
        "empty": F.coalesce(F.size(p), F.lit(0)) <= 0,
        "not_finite": F.exists(p, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
        "out_of_range": F.exists(p, lambda x: (x < 0) | (x > 1)),
        "bad_sum": F.abs(total - 1) > tolerance,
    }
    return first_violation(rules)


def path_reason(path: Column, forbidden: list[str], required: str) -> Column:
    """forbidden:<token> for the first forbidden token that a path holds, missing:<token> without the required one; empty if sound."""
    low = F.lower(path)
    rules = {f"forbidden:{t}": low.contains(t) for t in forbidden}
    return first_violation(rules | {f"missing:{required}": ~F.coalesce(low.contains(required), F.lit(False))})


def changes(before: DataFrame, after: DataFrame, name: str, digest: str) -> DataFrame:
    """(name, change) of artifacts of either side: same, changed, added, removed, or ambiguous where a side names it with several digests.

    Repeated equal rows are one; a null digest is a digest like others.
    """
    def one(rows: DataFrame, there: str, digest_as: str) -> DataFrame:
        kinds = F.count_distinct(F.struct(digest))
        return rows.groupBy(name).agg(F.first(digest).alias(digest_as), kinds.alias(there))

    both = one(before, "_a", "_x").join(one(after, "_b", "_y"), name, "full_outer")
    several = (F.coalesce("_a", F.lit(1)) > 1) | (F.coalesce("_b", F.lit(1)) > 1)
    change = F.when(several, "ambiguous").when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_x").eqNullSafe(F.col("_y")), "same").otherwise("changed")
    return both.select(name, change.alias("change"))


def id_list_reason(ids: Column, classes: int) -> Column:
    """Why an array is no list of class ids: repeated, out_of_range (also a null), or unsorted; empty text where it is one or is null."""
    rules = {
        "repeated": F.size(ids) != F.size(F.array_distinct(ids)),
        "out_of_range": F.exists(ids, lambda x: F.coalesce((x < 0) | (x >= classes), F.lit(True))),
        "unsorted": F.array_sort(ids) != ids,
    }
    return first_violation(rules)


def report_reason(p: Column, thresholds: Column, ids: Column, names: Column, known: list[str]) -> Column:
    """Why the inputs of a report contradict each other; empty text if they don't.

    length: probabilities or thresholds aren't one for each known name; out_of_range: one isn't within 0 and 1;
    then the reasons of id_list_reason; names: they aren't those of the ids, in the ids' order.
    """
    lengths = F.coalesce((F.size(p) == len(known)) & (F.size(thresholds) == len(known)), F.lit(False))
    outside = F.exists(F.concat(p, thresholds), lambda x: ~F.coalesce(x.between(0, 1), F.lit(False)))
    want = F.transform(ids, lambda i: F.get(F.array(*map(F.lit, known)), i))
    listed = id_list_reason(ids, len(known))
    return F.when(~lengths, "length").when(outside, "out_of_range").when(listed != "", listed).when(~F.coalesce(names.eqNullSafe(want), F.lit(False)), "names").otherwise("")


def duplicate_destinations(rows: DataFrame, path: str) -> DataFrame:
    """(path in lower case, n) of destinations that several rows would write; nulls are none."""
    return rows.where(F.col(path).isNotNull()).groupBy(F.lower(path).alias(path)).agg(F.count("*").alias("n")).where("n > 1")
