"""Counts and catalogues as maps of a bounded number of keys, their merge, and lookups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.relate import joined

#: What a lookup says of a key that a map lacks.
ABSENT = "not in catalogue"


def merge(a: Column, b: Column) -> Column:
    """Two maps of counts as one: keys of either, counts added; a null map is an empty one."""
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def count_maps(rows: DataFrame, by: list[str], key: str, most: int = 1000) -> DataFrame:
    """(by, counts, total, other): a map from the values of ``key`` (as text) to how often they occur in a group.

    A map holds the ``most`` commonest keys, of equally common ones the first; what it can't hold is counted by ``other``,
    so counts and ``other`` always sum to ``total``. A null key counts as other. Keys are counted before they meet, and
    only a group's first ``most`` leave the task that ranks a part of it.
    """
    counted = rows.groupBy(*by, F.col(key).cast("string").alias("_k")).agg(F.count("*").alias("_n"))
    total = counted.groupBy(*by).agg(F.sum("_n").alias("total"))
    parts = counted.where("_k IS NOT NULL").withColumn("_part", F.pmod(F.xxhash64("_k"), F.lit(64)))
    first = lambda c: F.slice(F.sort_array(c), 1, most)
    entry = F.struct((-F.col("_n")).alias("m"), F.col("_k").alias("k"))
    ranked = parts.withColumn("_i", F.row_number().over(W.partitionBy(*by, "_part").orderBy(F.desc("_n"), "_k"))).where(F.col("_i") <= most)
    held = ranked.groupBy(*by).agg(first(F.collect_list(entry)).alias("e"))
    maps = held.select(*by, F.map_from_entries(F.transform("e", lambda x: F.struct(x["k"], -x["m"]))).alias("counts"))
    out = joined(total, maps, by, "left").select(*by, F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"), "total")
    return out.withColumn("other", F.col("total") - F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x))


def roll_up(maps: DataFrame, by: list[str]) -> DataFrame:
    """(by, counts, total, other) of coarser groups from maps of finer ones: their keys, so as many as all finer maps hold together."""
    pairs = maps.select(*by, F.explode("counts").alias("k", "n")).groupBy(*by, "k").agg(F.sum("n").alias("n"))
    held = pairs.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("counts"))
    sums = maps.groupBy(*by).agg(F.sum("total").alias("total"), F.sum("other").alias("other"))
    return joined(sums, held, by, "left") if by else sums.crossJoin(held)


def look_up(counts: Column, key: Column) -> Column:
    """What a map holds for a key, as text, or that it isn't in the catalogue."""
    return F.coalesce(F.try_element_at(counts, key.cast("string")).cast("string"), F.lit(ABSENT))


def payload(rows: DataFrame, catalogue: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each row with ``found`` and ``payload``, a map of the catalogue's fields for its key as text.

    A key that the catalogue lacks, or a null one, has an empty map and ``status`` not in catalogue; one that it holds
    several times is ambiguous and has an empty map too.
    """
    entry = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)))
    known = catalogue.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.first(entry).alias("_e"))
    out = rows.join(known, key, "left")
    empty = F.create_map().cast("map<string,string>")
    status = F.when(F.col("_n").isNull(), ABSENT).when(F.col("_n") > 1, "ambiguous").otherwise("found")
    return out.withColumn("status", status).withColumn("payload", F.when(F.col("_n") == 1, F.col("_e")).otherwise(empty)).drop("_n", "_e")
