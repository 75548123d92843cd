"""Views of the driver's tables in the roles that the operators know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.cols import hash_unit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a content hash and a split that a hash of their id decides: 8 of 10 train, 1 val, 1 test."""
    u = F.pmod(hash_unit("42", F.col("doc_id")), F.lit(10))
    split = F.when(u < 8, "train").when(u == 8, "val").otherwise("test")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sha"), split.alias("split"))


SPLIT_DOCS = """SELECT doc_id, lang, source, n_chars, sha256(text) AS sha, CASE WHEN u < 8 THEN 'train' WHEN u = 8 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) % 10 AS u FROM documents)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from order lines, in an image of 100 x 80: some without area, outside, or over the edge."""
    q, d, p = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")
    x0, y0 = q * 3 - 20, d * 1000 - 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", x0.alias("x0"), y0.alias("y0"), (x0 + F.pmod(F.floor(p), F.lit(40)) - 4).alias("x1"), (y0 + F.pmod(F.floor(p / 7), F.lit(30)) - 2).alias("y1"), F.lit(100).alias("w"), F.lit(80).alias("h"))


BOXES = """SELECT *, x0 + (CAST(floor(l_extendedprice) AS BIGINT) % 40) - 4 AS x1, y0 + (CAST(floor(l_extendedprice / 7) AS BIGINT) % 30) - 2 AS y1, 100 AS w, 80 AS h
  FROM (SELECT *, l_quantity * 3 - 20 AS x0, l_discount * 1000 - 10 AS y0 FROM lineitem)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction among ten classes for each vector: the label, moved on for some ids; scores are small fractions."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("truth"))
    a = F.pmod(F.col("vec_id") * 7919, F.lit(101))
    b = F.pmod(F.col("vec_id") * 104729, F.lit(97))
    return v.withColumns({"predicted": F.when(a < 70, F.col("truth")).otherwise(F.pmod(F.col("truth") + a, F.lit(10))).cast("int"), "other": F.when(b < 60, F.col("truth")).otherwise(F.pmod(F.col("truth") + b, F.lit(10))).cast("int"), "score": (F.pmod(F.col("vec_id") * 31 + F.col("truth") * 13, F.lit(50)) / F.lit(50.0))})


PREDICTIONS = """SELECT vec_id, truth, CAST(CASE WHEN a < 70 THEN truth ELSE (truth + a) % 10 END AS INT) AS predicted,
  CAST(CASE WHEN b < 60 THEN truth ELSE (truth + b) % 10 END AS INT) AS other, ((vec_id * 31 + truth * 13) % 50) / 50.0::DOUBLE AS score
  FROM (SELECT vec_id, label AS truth, (vec_id * 7919) % 101 AS a, (vec_id * 104729) % 97 AS b FROM embeddings)"""
