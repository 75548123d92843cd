"""Queries of the corpus operators, with their parameters, and the SQL that a second engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import collocations, decontaminate, divergence, hard_negatives, lang_id, license_scan, line_dedup, ngram_join, oracle, packing, rule_ensemble, substring, token_counts, url_graph
from cairn.llm.common import documents, held_out


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return divergence.judge(docs, divergence.fit_references(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("hit_positions", "hit_items")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir))


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = rule_ensemble.fit(docs, labels.where(~held_out()))
    return rule_ensemble.predict(docs, model).withColumn("held_out", held_out())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = lang_id.fit(docs.where(~held_out()))
    return lang_id.predict(docs, model).withColumn("held_out", held_out())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary_path())


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id")
    vectors = vectors.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op12_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_distribution_divergence, op2_decontamination, op3_line_dedup, op4_rule_ensemble, op5_language_id, op6_substring_dedup, op7_ngram_jaccard_join, op8_license_scan, op9_token_counts, op10_best_fit_packing, op11_hard_negatives, op12_url_link_graph, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | {"op12_url_link_graph": oracle.url_graph_sql(URL_RULES, url_graph.LINK)}
