"""Nested documents as rows of paths and values, and where two of them differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.graph import ensure_checkpoint_dir
from cairn.operators.relate import joined


def _step(key: Column) -> Column:
    """A member of an object in a path; names that aren't plain are quoted."""
    quoted = F.concat(F.lit("['"), F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("']"))
    return F.when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), key)).otherwise(quoted)


def flatten_json(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, path, value) of every scalar of the documents in a text column, and of every empty object or list.

    ``value`` is JSON text, so the string "1" differs from the number 1, and a JSON null from an absent member. A text
    that is null or no JSON gives one row with a null value at ``$``. One level of nesting is taken apart at a time, in
    tasks; levels are written to the checkpoint folder, so a plan holds one level however deep documents go.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    names = [F.col(k) for k in key]
    level = rows.select(*names, F.lit("$").alias("path"), F.try_parse_json(column).alias("v"))
    out = None
    while True:
        text = F.to_json("v")
        typed = level.withColumns({"value": text, "_kind": F.when(text.isin("{}", "[]") | text.isNull(), "leaf").when(F.startswith(text, F.lit("{")), "object").when(F.startswith(text, F.lit("[")), "list").otherwise("leaf")}).checkpoint()
        leaves = typed.where("_kind = 'leaf'").select(*names, "path", "value")
        out = leaves if out is None else out.unionByName(leaves)
        inner = typed.where("_kind <> 'leaf'")
        if inner.isEmpty():
            return out
        inner.createOrReplaceTempView("_cairn_level")
        held = ", ".join(f"`{k}`" for k in key)
        opened = spark.sql(f"SELECT {held}, path, _kind, e.pos AS _pos, e.key AS _member, e.value AS v FROM _cairn_level, LATERAL variant_explode(v) AS e")
        deeper = F.when(F.col("_kind") == "object", _step(F.col("_member"))).otherwise(F.format_string("[%d]", F.col("_pos")))
        level = opened.select(*names, F.concat("path", deeper).alias("path"), "v")


def differences(first: DataFrame, second: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, path, first, second, change) of every path at which two documents of a key differ.

    change: changed, only_first, only_second, or ambiguous where one side has several documents of the key that don't
    agree at the path. Equal documents give no row; a key that one side lacks differs at all of its paths.
    """
    def one(rows: DataFrame, name: str) -> DataFrame:
        return flatten_json(rows, key, column).groupBy(*key, "path").agg(F.first("value").alias(name), F.count_distinct(F.struct("value")).alias(f"_n_{name}"))

    both = joined(one(first, "first"), one(second, "second"), [*key, "path"], "full_outer")
    several = (F.coalesce("_n_first", F.lit(1)) > 1) | (F.coalesce("_n_second", F.lit(1)) > 1)
    change = F.when(several, "ambiguous").when(F.col("_n_second").isNull(), "only_first").when(F.col("_n_first").isNull(), "only_second").when(~F.col("first").eqNullSafe(F.col("second")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").drop("_n_first", "_n_second")


def equal_configs(first: DataFrame, second: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, equal, different) for each key of either side: whether its documents are equal, and at how many paths they aren't."""
    found = differences(first, second, key, column).groupBy(*key).agg(F.count("*").alias("different"))
    keys = first.select(*key).unionByName(second.select(*key)).distinct()
    out = joined(keys, found, key, "left")
    return out.select(*key, F.col("different").isNull().alias("equal"), F.coalesce("different", F.lit(0)).alias("different"))
