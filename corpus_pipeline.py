"""Corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input.

All stages but the last return the columns of `documents`. Decisions name rows, by their place in the stage's input: so
rows that share a doc_id or have none are judged each by its own text. The input must be a table or otherwise give its
rows in the same order when it is read again. Empty tables pass through as empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, lang_id, line_dedup, ngram_join, packing
from cairn.llm.common import documents, ensure_checkpoint_dir, held_out
from cairn.llm.registry import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


ROW = "_row"


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _without(rows: DataFrame, named: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The numbered rows that ``named`` doesn't name; it is broadcast only where it is known to have few rows."""
    few = named.limit(broadcast_rows + 1).count() <= broadcast_rows
    return rows.join(F.broadcast(named) if few else named, ROW, "left_anti").drop(ROW)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter or without a language that is likelier than all others together."""
    rows = _numbered(docs)
    found = lang_id.predict(rows, lang_id.fit(docs.where(~held_out())), id_col=ROW)
    ensure_checkpoint_dir(spark)
    return _without(rows, found.where("lang_pred = 'und' OR score < 0.5").select(ROW).checkpoint())


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of texts; documents of which nothing but blanks is left go, if something was taken."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup.dedup_lines(docs, with_text=True, carry=tuple(rest))
    out = out.where("n_removed = 0 OR kept_text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").withColumnRenamed("kept_text", "text")
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of similar ones: that with the smallest id, of equal ids the first; null ids come last."""
    ensure_checkpoint_dir(spark)
    rows = _numbered(docs)
    found = ngram_join.jaccard_components(rows, id_col=ROW).select(ROW, "component_id").checkpoint()
    several = found.groupBy("component_id").agg(F.count("*").alias("c")).where("c > 1").select("component_id")
    copies = rows.select(ROW, "doc_id").join(found.join(several, "component_id"), ROW)
    first = copies.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW))[ROW].alias("kept"))
    return _without(rows, copies.join(first, "component_id").where(F.col(ROW) != F.col("kept")).select(ROW).checkpoint())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much of the benchmark's texts."""
    ensure_checkpoint_dir(spark)
    rows = _numbered(docs)
    found = decontaminate.find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW)
    return _without(rows, found.where("contaminated").select(ROW).checkpoint())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens: one row for each piece."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from `documents`; what they return is written to the folder that the cluster shares."""
    ensure_checkpoint_dir(spark)
    folder, docs = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}", documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
