"""Joins, reconciliation and set checks between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.graph import ensure_checkpoint_dir


def conflicts(rows: DataFrame, key: list[str], index: str, value: list[str]) -> DataFrame:
    """Ordered pairs of rows with equal keys and different values.

    Rows of a key are reduced to its distinct values first, so a key with one value costs nothing.
    """
    mixed = rows.groupBy(*key).agg(F.countDistinct(F.struct(*value)).alias("n")).where("n > 1").select(*key)
    own = rows.join(mixed, key)
    left, right = (own.select(*key, F.col(index).alias(f"{s}_{index}"), *(F.col(v).alias(f"{s}_{v}") for v in value)) for s in ("left", "right"))
    differ = F.lit(False)
    for v in value:
        differ = differ | ~F.col(f"left_{v}").eqNullSafe(F.col(f"right_{v}"))
    return left.join(right, key).where(differ)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of equal names in which nulls match: the columns of the left side, then the others of the right one."""
    same, other = F.lit(True), right
    for i, c in enumerate(on):
        other = other.withColumnRenamed(c, f"_on_{i}")
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{i}"))
    out = left.join(other, same, how)
    if how.startswith("full"):
        out = out.withColumns({c: F.coalesce(c, f"_on_{i}") for i, c in enumerate(on)})
    return out.drop(*(f"_on_{i}" for i in range(len(on))))


def conflict_members(rows: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Rows of keys that have several values, with how many rows of the key have another value: what ``conflicts`` pairs, without pairs.

    A key of n rows gives n rows. Null parts of a key match; values are compared whole, nulls as values.
    """
    kinds = rows.groupBy(*key, *value).agg(F.count("*").alias("_c"))
    totals = kinds.groupBy(*key).agg(F.sum("_c").alias("_n"), F.count("*").alias("values")).where("values > 1")

    told = joined(kinds, totals, key).withColumn("others", F.col("_n") - F.col("_c"))
    return joined(rows, told.drop("_n", "_c"), [*key, *value])


def content_members(rows: DataFrame, digest: str, part: str, source: str) -> DataFrame:
    """Rows of contents that stand several times, each with its group's numbers: copies, parts, sources, crosses_parts, crosses_sources.

    A group is as many rows as it has members, never one value that lists them. Null digests are in no group.
    """
    groups = rows.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("copies"), F.count_distinct(part).alias("parts"), F.count_distinct(source).alias("sources")).where("copies > 1")
    return rows.join(groups, digest).withColumns({"crosses_parts": F.col("parts") > 1, "crosses_sources": F.col("sources") > 1})


def content_groups(rows: DataFrame, digest: str, part: str, parts: list[str], path: str, source: str, most: int = 100) -> DataFrame:
    """(digest, records, paths, <part>_records.., sources, source_ids, is_cross_source) of contents that stand several times.

    ``source_ids`` names the first ``most`` sources in order, joined by semicolons; ``sources`` counts them all.
    """
    held = rows.where(F.col(digest).isNotNull())
    counts = held.groupBy(digest).agg(F.count("*").alias("records"), F.count_distinct(path).alias("paths"), *(F.count_if(F.col(part) == p).alias(f"{p}_records") for p in parts), F.count_distinct(source).alias("sources")).where("records > 1")
    several = held.join(counts.select(digest), digest).where(F.col(source).isNotNull()).select(digest, F.col(source).cast("string").alias("_s")).distinct()
    first = several.withColumn("_i", F.row_number().over(W.partitionBy(digest).orderBy("_s"))).where(F.col("_i") <= most)
    named = first.groupBy(digest).agg(F.array_join(F.array_sort(F.collect_list("_s")), ";").alias("source_ids"))
    out = counts.join(named, digest, "left")
    return out.withColumn("source_ids", F.coalesce("source_ids", F.lit(""))).withColumn("is_cross_source", F.col("sources") > 1)


def discordant(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Rows on which two columns differ; a null differs from any value, and not from a null."""
    return rows.where(~F.col(first).eqNullSafe(F.col(second)))


def augmentation_leak(rows: DataFrame, original: str, augmented: str, split: str = "split", train: str = "train") -> DataFrame:
    """Originals of augmented training rows that a split other than training holds too, with how many rows each side has."""
    own, other = (F.col(split) == train) & F.col(augmented), F.col(split) != train
    held = rows.where(F.col(original).isNotNull()).groupBy(original).agg(F.count_if(own).alias("augmented_rows"), F.count_if(other).alias("held_out_rows"))
    return held.where("augmented_rows > 0 AND held_out_rows > 0")


def reconcile(template: DataFrame, reviews: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, outcome): missing, matched (all reviews equal), conflicting, or unmatched (not in the template)."""
    folded = reviews.groupBy(key).agg(F.countDistinct(F.struct(*(F.coalesce(F.trim(f), F.lit("")).alias(f) for f in fields))).alias("kinds"), F.count("*").alias("reviews"))
    both = template.select(key, F.lit(True).alias("asked")).dropDuplicates([key]).join(folded, key, "full_outer")
    outcome = F.when(F.col("asked").isNull(), "unmatched").when(F.col("kinds").isNull(), "missing").when(F.col("kinds") == 1, "matched").otherwise("conflicting")
    return both.select(key, outcome.alias("outcome"), F.coalesce("reviews", F.lit(0)).cast("long").alias("reviews"))


def mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of the left side that differ, with the names of the fields in which they do; ``missing`` without a counterpart."""
    other = right.select(key, F.lit(True).alias("_there"), *(F.col(f).alias(f"_{f}") for f in fields))
    names = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields)))
    names = F.when(F.col("_there").isNull(), F.array(F.lit("missing"))).otherwise(names)
    return left.select(key, *fields).join(other, key, "left").withColumn("fields", names).where(F.size("fields") > 0).select(key, F.array_join("fields", ";").alias("fields"))


def missing_and_unexpected(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    a = expected.join(actual, key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit("missing").alias("side"))
    return a.unionByName(actual.join(expected, key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit("unexpected").alias("side")))


def crossing(rows: DataFrame, field: str, split: str = "split") -> DataFrame:
    """Values that more than one split holds, with the splits."""
    out = rows.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.array_sort(F.collect_set(split)).alias("s"))
    return out.where(F.size("s") > 1).select("value", F.array_join("s", ";").alias("splits"))


def leakage_audit(rows: DataFrame, fields: list[str], split: str = "split") -> DataFrame:
    """A row for each field: how many of its values cross splits, PASS or FAIL, and the first twenty.

    One scan: each row becomes one of (field, value, split) for every field, and values are grouped once. The first
    twenty are taken in each partition of values before they meet.
    """
    every = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x"), F.col(split).alias("s"))
    values = every.where("x.value IS NOT NULL").groupBy("x.field", "x.value").agg((F.min("s") != F.max("s")).alias("crosses")).where("crosses")
    w = W.partitionBy("field", "part").orderBy("value")
    parts = values.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(64))).withColumn("i", F.row_number().over(w))
    found = parts.groupBy("field").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.when(F.col("i") <= 20, F.col("value")))), 1, 20).alias("first"))
    names = rows.sparkSession.createDataFrame([(f,) for f in fields], "field string").join(F.broadcast(found), "field", "left")
    return names.select(F.col("field").alias("audit_name"), F.coalesce("n", F.lit(0)).cast("long").alias("leakage_count"), F.when(F.col("n") > 0, "FAIL").otherwise("PASS").alias("status"), F.coalesce(F.array_join("first", ";"), F.lit("")).alias("details"))


def lookup(rows: DataFrame, catalogue: DataFrame, content: str, name: str, value: str) -> DataFrame:
    """``value`` by content, where the catalogue has that content once, else by name; and how it was found."""
    once = catalogue.groupBy(F.col(content).alias("_c")).agg(F.count("*").alias("_n"), F.min(value).alias("_by_content")).where("_n = 1").drop("_n")
    named = catalogue.groupBy(F.col(name).alias("_m")).agg(F.min(value).alias("_by_name"))
    out = rows.join(once, rows[content] == F.col("_c"), "left").join(named, rows[name] == F.col("_m"), "left")
    how = F.when(F.col("_c").isNotNull(), "sha256").when(F.col("_m").isNotNull(), "image_id").otherwise("none")
    return out.withColumn("found", F.coalesce("_by_content", "_by_name")).withColumn("method", how).drop("_c", "_m", "_by_content", "_by_name")


def first_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Marks all but the first row of a key as duplicates, with the order value of the first one."""
    w = W.partitionBy(*key).orderBy(order)
    first = F.first(order).over(w)
    return rows.withColumn("is_duplicate", F.row_number().over(w) > 1).withColumn("duplicate_of", F.when(F.col("is_duplicate"), first))


def grid(counts: DataFrame, keys: dict[str, list], fill: list[str]) -> DataFrame:
    """Every combination of the given key values, with zeros where ``counts`` has no row."""
    spark, out = counts.sparkSession, None
    for name, values in keys.items():
        one = spark.createDataFrame([(v,) for v in values], f"{name} {counts.schema[name].dataType.simpleString()}")
        out = one if out is None else out.crossJoin(one)
    return out.join(counts, list(keys), "left").fillna(0, fill)


def running_sums(rows: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds a running sum of each of ``sums`` over the rows of a key, the row itself included, in an order that tells rows apart.

    No task holds a key: rows are sorted by range once, summed within each range, and what the ranges before hold is
    added. The ranges are written first, since their borders come from a sample.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    ranged = rows.withColumns({f"_x_{n}": c for n, c in sums.items()}).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    held = ranged.groupBy(*by, "_range").agg(*(F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums))
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = held.select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(by)), F.col("_range").alias("_of"), *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums))
    inside = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    same = F.col("_range") == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_key{i}"))
    own = ranged.withColumns({f"_i_{n}": F.sum(f"_x_{n}").over(inside) for n in sums})
    return own.join(offsets, same).select(*rows.columns, *((F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums))


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Adds ``name``: the place of a row among those of its key, from 0, in the order of some columns that tell rows apart."""
    return running_sums(rows, by, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def with_status(rows: DataFrame, index: DataFrame, key: str, path: str) -> DataFrame:
    """All rows, with the first path of the index for their key and a status: copied, missing, or error where the path is blank."""
    first = index.groupBy(key).agg(F.min(path).alias(path), F.lit(True).alias("_there"))
    out = rows.join(first, key, "left")
    status = F.when(F.col("_there").isNull(), "missing").when(F.coalesce(F.trim(path), F.lit("")) == "", "error").otherwise("copied")
    return out.withColumn("status", status).drop("_there")


def matched_and_left_over(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of every key of either side: both, left_only or right_only."""
    a, b = (x.select(F.col(key)).where(F.col(key).isNotNull()).distinct() for x in (left, right))
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full_outer")
    return both.select(key, F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both").alias("side"))


def absent_if_any(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``known`` lacks; none where ``known`` is empty, since then it says nothing."""
    any_known = F.broadcast(known.select(F.lit(1).alias("_any")).limit(1))
    return rows.join(known.select(key).distinct(), key, "left_anti").join(any_known, how="left_semi", on=F.lit(True))


def unequal_ids(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Ids that not all of some sources hold, with the names of those that do; empty where all are equal sets."""
    every = None
    for name, rows in sources.items():
        one = rows.select(F.col(key).cast("string").alias("id"), F.lit(name).alias("source")).where("id IS NOT NULL")
        every = one if every is None else every.unionByName(one)
    held = every.groupBy("id").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") < len(sources))
    return held.select("id", F.array_join("s", ";").alias("held_by"))


def by_fallback(rows: DataFrame, manifest: DataFrame, index: str, fallback: list[str], columns: list[str]) -> DataFrame:
    """Rows with ``columns`` of the manifest row of the same index or, where the manifest has no such index, of the same fallback key.

    ``matched_by`` is index, fallback, none, or ambiguous where the key that would match stands in several manifest rows:
    such a row gets no values. Null keys match nothing, and rows with a null index aren't joined by it.
    """
    def once(key: list[str], name: str) -> DataFrame:
        return manifest.dropna(subset=key).groupBy(*key).agg(F.struct(F.count("*").alias("n"), *(F.first(c).alias(c) for c in columns)).alias(name))

    no_match = once([index], "_first").schema["_first"].dataType
    indexed = rows.where(F.col(index).isNotNull()).join(once([index], "_first"), index, "left").select(*rows.columns, "_first")
    every = indexed.unionByName(rows.where(F.col(index).isNull()).withColumn("_first", F.lit(None).cast(no_match)))
    kept = every.where("_first IS NOT NULL").withColumn("_second", F.lit(None).cast(no_match))
    rest = every.where("_first IS NULL").join(once(fallback, "_second"), fallback, "left").select(*rows.columns, "_first", "_second")
    taken = F.coalesce("_first", "_second")
    how = F.when(taken.isNull(), "none").when(taken["n"] > 1, "ambiguous").when(F.col("_first").isNotNull(), "index").otherwise("fallback")
    return kept.unionByName(rest).select(*rows.columns, *(F.when(taken["n"] == 1, taken[c]).alias(c) for c in columns), how.alias("matched_by"))


def paired(models: dict[str, DataFrame], key: list[str], columns: list[str]) -> DataFrame:
    """One row for each key that all models have, with ``<model>_<column>`` for each."""
    out = None
    for name, rows in models.items():
        one = rows.select(*key, *(F.col(c).alias(f"{name}_{c}") for c in columns))
        out = one if out is None else out.join(one, key)
    return out


def unpaired(models: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Keys that not every model has exactly once: the key and the number of rows of each model. Empty where pairing is sound."""
    every = None
    for name, rows in models.items():
        one = rows.groupBy(*key).agg(*((F.count("*") if n == name else F.lit(0)).cast("long").alias(f"n_{n}") for n in models))
        every = one if every is None else every.unionByName(one)
    summed = every.groupBy(*key).agg(*(F.sum(f"n_{n}").alias(f"n_{n}") for n in models))
    return summed.where(" OR ".join(f"n_{n} <> 1" for n in models))


def by_rules(rows: DataFrame, labels: str, rules: DataFrame, most: int = 10_000) -> DataFrame:
    """Rules (position, label, text) that apply to each row's array of labels, in the rules' order: one row for each.

    Up to ``most`` rules are broadcast; more of them meet the rows by label.
    """
    few = rules.limit(most + 1).count() <= most
    return rows.withColumn("label", F.explode(labels)).join(F.broadcast(rules) if few else rules, "label").drop(labels)


def corrections(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """One row: how many keys both sides have (matched), and how many of them have another value afterwards (corrected). Keys are unique."""
    joined = before.select(*key, F.col(value).alias("_a")).join(after.select(*key, F.col(value).alias("_b")), key)
    return joined.agg(F.count("*").alias("matched"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("corrected"))
