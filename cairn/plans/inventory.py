"""Queries that take stock: stored vectors and shards, stems, destinations, matrices, sections of texts, covering samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import cols
from cairn.operators import compare, relate, samples, validate, vectors
from cairn.plans.catalogue import query
from cairn.plans.tables import PREDICTIONS, predictions, table
from cairn.sources import readers

_SHARDS = """SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN vec_id - 1 WHEN vec_id % 97 = 5 THEN -1 ELSE vec_id END AS i,
  CASE WHEN vec_id % 31 = 0 THEN 'old' ELSE 'new' END AS revision, CASE WHEN vec_id % 41 = 0 THEN list_slice(embedding, 1, 8) ELSE embedding END AS v FROM embeddings"""
_FAULTY = "len(v) IS NULL OR len(v) <> 64"
_ODD = "len(list_filter(v, lambda x: isnan(x) OR isinf(x))) > 0"
_ZERO = "len(list_filter(v, lambda x: x <> 0)) = 0"
_REASONS = f"""SELECT *, CASE WHEN r = '' AND count(*) FILTER (WHERE r = '') OVER (PARTITION BY i) > 1 THEN 'duplicate' ELSE r END AS reason FROM (SELECT *, CASE WHEN revision <> 'new' THEN 'provenance'
  WHEN i < 0 OR i >= (SELECT count(*) FROM embeddings) THEN 'out_of_range' WHEN {_FAULTY} THEN 'bad_shape' WHEN {_ODD} THEN 'not_finite' WHEN {_ZERO} THEN 'zero_norm' ELSE '' END AS r FROM ({_SHARDS}))"""


def _shards(spark, d):
    """Stored vectors as shards that a stopped run left: some of another revision, cut short, misplaced or written twice."""
    e, k = table(spark, d, "embeddings"), F.col("vec_id")
    i = F.when(k % 50 == 7, k - 1).when(k % 97 == 5, -1).otherwise(k)
    return e.select("vec_id", i.alias("i"), F.when(k % 31 == 0, "old").otherwise("new").alias("revision"), F.when(k % 41 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("v"))


def _judged(spark, d):
    return vectors.shard_reason(_shards(spark, d), "i", "v", table(spark, d, "embeddings").count(), 64, {"revision": "new"})


@query(f"SELECT vec_id, i, reason FROM ({_REASONS})")
def resume_shards(spark, d):
    return _judged(spark, d).select("vec_id", "i", "reason")


@query(f"SELECT vec_id AS i FROM embeddings WHERE vec_id NOT IN (SELECT i FROM ({_REASONS}) WHERE reason = '')")
def resume_remaining(spark, d):
    return vectors.still_to_do(table(spark, d, "embeddings").select(F.col("vec_id").alias("i")), _judged(spark, d), "i")


@query(f"""WITH n AS (SELECT count(*) AS expected FROM embeddings), s AS ({_SHARDS}), t AS (SELECT count(*) AS rows, count(DISTINCT i) AS unique_indices, count(DISTINCT i) FILTER (WHERE i >= 0 AND i < (SELECT expected FROM n)) AS inside,
  count(*) FILTER (WHERE i < 0 OR i >= (SELECT expected FROM n)) AS out_of_range, count(*) FILTER (WHERE {_FAULTY}) AS bad_shape, count(*) FILTER (WHERE NOT ({_FAULTY}) AND {_ODD}) AS not_finite, count(*) FILTER (WHERE NOT ({_FAULTY}) AND {_ZERO}) AS zero_norm FROM s)
  SELECT CAST(rows AS BIGINT) AS rows, CAST(unique_indices AS BIGINT) AS unique_indices, CAST(expected - inside AS BIGINT) AS missing, CAST(rows - unique_indices AS BIGINT) AS duplicates, CAST(out_of_range AS BIGINT) AS out_of_range, CAST(bad_shape AS BIGINT) AS bad_shape,
  CAST(not_finite AS BIGINT) AS not_finite, CAST(zero_norm AS BIGINT) AS zero_norm, CASE WHEN expected = inside AND rows = unique_indices AND out_of_range + bad_shape + not_finite + zero_norm = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM t, n""")
def cache_check(spark, d):
    return vectors.cache_check(_shards(spark, d), "i", "v", table(spark, d, "embeddings").count(), 64)


@query("SELECT truth, " + ", ".join(f"CAST(count(*) FILTER (WHERE predicted = {c}) AS BIGINT) AS predicted_class_{c}" for c in range(10)) + f" FROM ({PREDICTIONS}) GROUP BY 1")
def confusion_rows(spark, d):
    return compare.matrix_rows(_counted(spark, d), list(range(10)))


def _counted(spark, d):
    return predictions(spark, d).groupBy("truth", "predicted").agg(F.count("*").alias("n"))


@query(f"SELECT t.truth, CAST(p.c AS INT) AS predicted, CAST(count(*) FILTER (WHERE t.predicted = p.c) AS BIGINT) AS n FROM ({PREDICTIONS}) t, range(10) p(c) GROUP BY 1, 2")
def confusion_cells_of_rows(spark, d):
    """Cells of the matrix in its wide form, as a stored report has it."""
    return compare.matrix_cells(compare.matrix_rows(_counted(spark, d), list(range(10))), "truth")


@query("SELECT regexp_extract(url, '([^/]+?)(?:\\.[^./]+)?$', 1) AS stem, CAST(count(*) AS BIGINT) AS copies, CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list(url)), ' ') END AS paths FROM pages GROUP BY 1")
def path_stems(spark, d):
    return readers.stems(table(spark, d, "pages"), "url").withColumn("paths", F.array_join("paths", " "))


@query("SELECT lower(p) AS path, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderpriority || '/' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '.PNG' ELSE '.png' END AS p FROM orders) WHERE p IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_destinations(spark, d):
    path = F.concat("o_orderpriority", F.lit("/"), "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, ".PNG").otherwise(".png"))
    return validate.duplicate_destinations(table(spark, d, "orders").select(path.alias("path")), "path")


@query("""SELECT CAST(count(*) AS BIGINT) AS matched, CAST(count(*) FILTER (WHERE a.l_partkey IS DISTINCT FROM b.p) AS BIGINT) AS corrected
  FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 7 = 0 THEN l_partkey + 1 ELSE l_partkey END AS p FROM lineitem WHERE l_linenumber < 5) b USING (l_orderkey, l_linenumber)""")
def index_corrections(spark, d):
    lines = table(spark, d, "lineitem")
    after = lines.where("l_linenumber < 5").withColumn("l_partkey", F.when(F.col("l_suppkey") % 7 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")))
    return relate.corrections(lines, after, ["l_orderkey", "l_linenumber"], "l_partkey")


@query(f"""SELECT CASE WHEN predicted = truth AND other = truth THEN 'exact' WHEN predicted = truth OR other = truth THEN 'partial' ELSE 'miss' END AS kind, CAST(count(*) AS BIGINT) AS n FROM ({PREDICTIONS}) GROUP BY 1""")
def match_kinds(spark, d):
    """How the classes that two models name meet the true one."""
    kind = compare.match_kind(F.array("truth"), F.array_distinct(F.array("predicted", "other")))
    return predictions(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT vec_id, CASE WHEN predicted = other THEN 'repeated' WHEN predicted > 8 OR other > 8 THEN 'out_of_range' WHEN predicted > other THEN 'unsorted' ELSE '' END AS reason FROM ({PREDICTIONS})")
def id_list_checks(spark, d):
    return predictions(spark, d).select("vec_id", validate.id_list_reason(F.array("predicted", "other"), 9).alias("reason"))


@query("""SELECT doc_id, CASE WHEN strpos(rest, '. ') > 0 AND place > 0 THEN trim(substr(rest, 1, strpos(rest, '. ') - 1)) WHEN place > 0 THEN trim(rest) ELSE '' END AS section,
  trim(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT contains(l, 'the') AND NOT contains(l, 'der')), chr(10))) AS kept FROM (SELECT doc_id, text, strpos(text, ' and ') AS place, substr(text, strpos(text, ' and ') + 5) AS rest FROM documents WHERE text IS NOT NULL)""")
def text_sections(spark, d):
    """What follows a heading in a text, up to the next mark, and the text without lines that hold some terms."""
    text = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", cols.section(text, " and ", ". ").alias("section"), cols.without_lines(text, ["the", "der"]).alias("kept"))


@query()
def covering_sample(spark, d):
    """30 orders with quotas by the number of kinds of their lines, each kind covered 8 times; chosen step by step, so without SQL."""
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    orders = table(spark, d, "lineitem").where("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(kind)).alias("kinds"))
    return samples.covering(orders, "kinds", "l_orderkey", 30, 3)
