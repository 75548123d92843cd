"""Queries that validate, reconcile and sample the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import cols
from cairn.operators import audits as sets
from cairn.operators import compare, history, metrics, relate, samples, splits, validate, vectors
from cairn.plans.catalogue import _DAYS, _days, query, r6
from cairn.plans.tables import PREDICTIONS, SPLIT_DOCS, predictions, split_docs, table

_DOC_RULES = {"missing_id": "doc_id IS NULL", "bad_class": "lang NOT IN ('de', 'en', 'es', 'fr')", "empty_text": "n_chars < 20", "name_mismatch": "n_chars <> length(text)"}


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 1 AS csv_row, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _DOC_RULES.items()) + " ELSE '' END AS reason FROM documents")
def row_validity(spark, d):
    """The first rule that a row breaks, and the line that it would have below a header."""
    docs = table(spark, d, "documents").withColumn("reason", validate.first_violation({n: F.expr(c) for n, c in _DOC_RULES.items()}))
    return relate.numbered(docs.select("doc_id", "reason"), [], ["doc_id"], "i").select("doc_id", (F.col("i") + 2).alias("csv_row"), "reason")


_ORDER_RULES = {"bad_status": "o_orderstatus NOT IN ('F', 'O')", "low_price": "o_totalprice < 2000", "blank_priority": "trim(coalesce(o_orderpriority, '')) = ''", "urgent_late": "o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'"}


@query(" UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS reason FROM orders WHERE {c}" for n, c in _ORDER_RULES.items()))
def manifest_violations(spark, d):
    return validate.violations(table(spark, d, "orders"), ["o_orderkey"], {n: F.expr(c) for n, c in _ORDER_RULES.items()})


@query("SELECT CAST(count(*) AS BIGINT) AS rows, " + ", ".join(f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS {n}" for n, c in _ORDER_RULES.items()) + ", CASE WHEN count(*) > 0 AND " + " AND ".join(f"count(*) FILTER (WHERE {c}) = 0" for c in _ORDER_RULES.values()) + " THEN 'PASS' ELSE 'FAIL' END AS status FROM orders")
def audit_summary(spark, d):
    return validate.summary(table(spark, d, "orders"), {n: F.expr(c) for n, c in _ORDER_RULES.items()})


@query("SELECT o_custkey, o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT coalesce(o_orderstatus, '?')) AS BIGINT) AS \"values\" FROM orders GROUP BY 1, 2 HAVING count(DISTINCT coalesce(o_orderstatus, '?')) > 1")
def ambiguous_keys(spark, d):
    return validate.ambiguous_keys(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus")


@query("SELECT CAST(sum(c) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS distinct_n, CAST(count(*) FILTER (WHERE c > 1) AS BIGINT) AS repeated, CAST(sum(c - 1) AS BIGINT) AS beyond_first, CAST(sum(c) - count(*) AS BIGINT) AS excess FROM (SELECT count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY sha256(text))")
def duplicate_excess(spark, d):
    return validate.duplicate_excess(split_docs(spark, d), "sha")


@query(f"SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 'out_of_range' WHEN vec_id % 7 = 0 THEN 'bad_sum' ELSE '' END AS reason FROM ({PREDICTIONS})")
def probability_checks(spark, d):
    s = F.col("score")
    p = F.when(F.col("vec_id") % 13 == 0, F.array(s + 1.5, -s - 0.5)).when(F.col("vec_id") % 7 == 0, F.array(s / 2, (1 - s) / 3)).otherwise(F.array(s, 1 - s))
    return predictions(spark, d).select("vec_id", validate.probability_reason(p).alias("reason"))


@query(f"""SELECT vec_id, CAST(i AS INT) AS class_id, CASE WHEN i = 0 THEN score ELSE 1 - score END AS p, CASE WHEN i = 0 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS threshold, CASE WHEN i = 0 THEN score >= 0.5 ELSE 1 - score >= 0.3::DOUBLE END AS decision FROM ({PREDICTIONS}) CROSS JOIN range(2) q(i)""")
def probability_rows(spark, d):
    arrays = predictions(spark, d).select("vec_id", F.array("score", 1 - F.col("score")).alias("p"), F.array(F.lit(0.5), F.lit(0.3)).alias("t"))
    return metrics.probability_rows(arrays, ["vec_id"], "p", "t")


@query(f"SELECT vec_id, score AS probability_0, 1 - score AS probability_1, 0.5::DOUBLE AS threshold_0, 0.3::DOUBLE AS threshold_1, CAST(score >= 0.5 AS INT) AS decision_0, CAST(1 - score >= 0.3::DOUBLE AS INT) AS decision_1 FROM ({PREDICTIONS})")
def wide_prediction_rows(spark, d):
    from cairn.sources.writers import wide_predictions

    return wide_predictions(predictions(spark, d).select("vec_id", F.array("score", 1 - F.col("score")).alias("p"), F.array(F.lit(0.5), F.lit(0.3)).alias("t")), "p", "t", 2)


@query("SELECT page_id, CASE WHEN contains(lower(url), 'test') THEN 'forbidden:test' WHEN contains(lower(url), 'tmp') THEN 'forbidden:tmp' WHEN NOT coalesce(contains(lower(url), 'http'), false) THEN 'missing:http' ELSE '' END AS reason FROM pages")
def path_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", validate.path_reason(F.col("url"), ["test", "tmp"], "http").alias("reason"))


@query("SELECT l_orderkey, l_linenumber, printf('%d_class%d_bbox%04d', l_orderkey, l_linenumber, l_partkey % 10000) AS crop_id, replace('raw/' || l_orderkey || '/raw/' || l_linenumber, 'raw/', 'final/') AS path FROM lineitem")
def crop_names(spark, d):
    path = F.concat(F.lit("raw/"), F.col("l_orderkey"), F.lit("/raw/"), F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cols.crop_name(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey") % 10000).alias("crop_id"), cols.with_prefix(path, "raw/", "final/").alias("path"))


@query("""SELECT d.doc_id, l.path, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.path = '' THEN 'error' ELSE 'copied' END AS status
  FROM documents d LEFT JOIN (SELECT doc_id, min(CASE WHEN quality = 0 THEN '' ELSE 'q/' || doc_id END) AS path FROM labels GROUP BY 1) l USING (doc_id)""")
def index_status(spark, d):
    index = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "").otherwise(F.concat(F.lit("q/"), "doc_id")).alias("path"))
    return relate.with_status(table(spark, d, "documents").select("doc_id"), index, "doc_id", "path")


@query("SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k")
def leftover_keys(spark, d):
    return relate.matched_and_left_over(table(spark, d, "orders").select(F.col("o_custkey").alias("key")), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key")


@query("SELECT doc_id, 'labels' AS against FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def guarded_membership(spark, d):
    """Documents without a label; a second set, which is empty, says nothing."""
    docs, known = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    one = relate.absent_if_any(docs, known, "doc_id").withColumn("against", F.lit("labels"))
    return one.unionByName(relate.absent_if_any(docs, known.where("doc_id < 0"), "doc_id").withColumn("against", F.lit("nothing")))


@query("""WITH e AS (SELECT c_custkey AS id, 'customer' AS s FROM customer UNION SELECT o_custkey, 'orders' FROM orders UNION SELECT user_id, 'events' FROM events UNION SELECT s_suppkey, 'supplier' FROM supplier)
  SELECT CAST(id AS VARCHAR) AS id, string_agg(s, ';' ORDER BY s) AS held_by FROM e WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) < 4""")
def id_sources(spark, d):
    sources = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id", "supplier": "s_suppkey"}
    return relate.unequal_ids({t: table(spark, d, t).select(F.col(c).alias("id")) for t, c in sources.items()}, "id")


@query(f"SELECT DISTINCT sha FROM ({SPLIT_DOCS}) WHERE split = 'train' AND sha IN (SELECT sha FROM ({SPLIT_DOCS}) WHERE split <> 'train')")
def augmented_lineage_leak(spark, d):
    """Originals of training rows that val or test hold too."""
    docs = split_docs(spark, d)
    return docs.where("split = 'train'").select("sha").intersect(docs.where("split <> 'train'").select("sha")).where("sha IS NOT NULL")


_RULES = [(0, 1, "toxic: review"), (1, 0, "quality: keep"), (2, 1, "toxic: second reader")]


@query("WITH r(position, label, text) AS (VALUES " + ", ".join(map(str, _RULES)) + ") SELECT doc_id, CAST(position AS INT) AS position, text FROM labels JOIN r ON (label = 0 AND quality = 1) OR (label = 1 AND toxic = 1)")
def rules_of_labels(spark, d):
    ids = F.array_compact(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1)))
    rules = spark.createDataFrame(_RULES, "position int, label int, text string")
    return relate.by_rules(table(spark, d, "labels").select("doc_id", ids.alias("labels")), "labels", rules).select("doc_id", "position", "text")


_SOURCES = "SELECT source, CASE WHEN u < 8 THEN 'train' WHEN u = 8 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT source, CAST('0x' || substr(sha256('42:' || source), 1, 8) AS BIGINT) % 10 AS u FROM documents WHERE source IS NOT NULL)"


def _assigned(spark, d):
    from cairn.functions.cols import hash_unit

    u = F.pmod(hash_unit("42", F.col("source")), F.lit(10))
    return table(spark, d, "documents").where("source IS NOT NULL").select("source").distinct().withColumn("split", F.when(u < 8, "train").when(u == 8, "val").otherwise("test"))


@query(f"""SELECT doc_id, source, lang, split, part FROM (SELECT *, 'balanced' AS part FROM documents WHERE n_chars > 400) JOIN ({_SOURCES}) USING (source) WHERE split = 'train' UNION ALL SELECT doc_id, source, lang, split, 'original' FROM documents JOIN ({_SOURCES}) USING (source) WHERE split <> 'train'""")
def split_manifest(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return splits.manifest(docs.withColumn("part", F.lit("original")), docs.where("n_chars > 400").withColumn("part", F.lit("balanced")), _assigned(spark, d), "source").select("doc_id", "source", "lang", "split", "part")


@query(f"""WITH t AS (SELECT lang, count(*) AS total FROM ({SPLIT_DOCS}) GROUP BY 1), q AS (SELECT lang, total, CAST(round_even(total * 0.8, 0) AS BIGINT) AS train, CAST(round_even(total * 0.1, 0) AS BIGINT) AS val FROM t),
  w AS (SELECT lang, 'train' AS split, train AS target FROM q UNION ALL SELECT lang, 'val', val FROM q UNION ALL SELECT lang, 'test', total - train - val FROM q)
  SELECT w.lang, w.split, CAST(count(x.doc_id) AS BIGINT) AS n, CAST(target AS BIGINT) AS target, CAST(count(x.doc_id) - target AS BIGINT) AS difference_from_target FROM w LEFT JOIN ({SPLIT_DOCS}) x ON x.lang IS NOT DISTINCT FROM w.lang AND x.split = w.split GROUP BY 1, 2, target""")
def split_audit(spark, d):
    return splits.audit(split_docs(spark, d), "lang")


@query(f"""SELECT CASE grouping(lang, split, source) WHEN 3 THEN 'lang' WHEN 5 THEN 'split' WHEN 6 THEN 'source' WHEN 1 THEN 'lang_split' ELSE 'all' END AS view, CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, CASE WHEN grouping(split) = 1 THEN 'ALL' ELSE split END AS split, CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, CAST(count(*) AS BIGINT) AS n
  FROM ({SPLIT_DOCS}) GROUP BY GROUPING SETS ((lang), (split), (source), (lang, split), ())""")
def review_views(spark, d):
    return sets.views(split_docs(spark, d), {"lang": ["lang"], "split": ["split"], "source": ["source"], "lang_split": ["lang", "split"], "all": []})


@query("""SELECT conv_id, CAST(max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS INT) AS has_user, CAST(max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS INT) AS has_assistant, CAST(max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS INT) AS has_system,
  CAST(count(*) AS BIGINT) AS turns, count(DISTINCT role) > 1 AS several FROM conversations GROUP BY 1""")
def presence_flags(spark, d):
    return validate.presence(table(spark, d, "conversations"), ["conv_id"], "role", ["user", "assistant", "system"]).withColumnRenamed("rows", "turns")


@query("SELECT doc_id, 0 AS class_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 1 FROM labels WHERE toxic = 1")
def class_membership(spark, d):
    """The inverted index as rows, so that no class is one value."""
    ids = F.array_compact(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1)))
    return table(spark, d, "labels").select("doc_id", F.explode(ids).alias("class_id"))


@query(f"SELECT doc_id, lang FROM ({SPLIT_DOCS}) ORDER BY sha256('42:' || doc_id), doc_id LIMIT 10")
def overlay_sample(spark, d):
    return samples.shuffled(split_docs(spark, d).select("doc_id", "lang"), "doc_id", 10)


@query(f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY lang, split ORDER BY CASE WHEN n_chars > 3000 THEN 0 ELSE 1 END, sha256('42:' || doc_id), doc_id) AS i FROM ({SPLIT_DOCS})),
  p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN i = 1 THEN 0 ELSE 1 END, CASE WHEN n_chars > 3000 THEN 0 ELSE 1 END, sha256('42:' || doc_id), doc_id) AS pick FROM h)
  SELECT doc_id, lang, split, CAST(pick AS INT) AS pick FROM p WHERE pick <= 6 ORDER BY pick, lang LIMIT 30""")
def priority_sample(spark, d):
    return samples.priority(split_docs(spark, d), "lang", "split", F.col("n_chars") > 3000, "doc_id", 6, 30).select("doc_id", "lang", "split", "pick")


@query("""WITH v AS (SELECT label, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS q, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM embeddings)
  SELECT label, label IS NULL AS overall, CAST(count(*) AS BIGINT) AS vectors, CAST(sum(n) AS BIGINT) AS components, CAST(0 AS BIGINT) AS not_finite, CAST(count(*) FILTER (WHERE q = 0) AS BIGINT) AS zero_norm, round(min(low), 6) AS low, round(max(high), 6) AS high, round(sum(s) / sum(n), 5) AS mean,
  round(sqrt(greatest(sum(q) / sum(n) - pow(sum(s) / sum(n), 2), 0)), 5) AS std, round(avg(sqrt(q)), 5) AS mean_norm, round(max(sqrt(q)), 5) AS max_norm FROM v GROUP BY GROUPING SETS ((label), ())""")
def vector_statistics(spark, d):
    out = vectors.statistics(table(spark, d, "embeddings"), "embedding", "label")
    return out.select("label", "overall", "vectors", "components", "not_finite", "zero_norm", r6("low").alias("low"), r6("high").alias("high"), *(F.round(c, 5).alias(c) for c in ("mean", "std", "mean_norm", "max_norm")))


_SHIFTED = "SELECT vec_id, label, embedding AS a, list_transform(embedding, lambda x: x::DOUBLE * CASE WHEN vec_id % 4 = 0 THEN 1.01 ELSE 1.000001 END) AS b FROM embeddings"


def _shifted(spark, d):
    e = table(spark, d, "embeddings")
    factor = F.when(F.col("vec_id") % 4 == 0, F.lit(1.01)).otherwise(F.lit(1.000001))
    return e.select("vec_id", "label", F.col("embedding").alias("a"), F.transform("embedding", lambda x: x.cast("double") * factor).alias("b"))


@query(f"""SELECT vec_id, list_bool_and(list_transform(list_zip(a, b), lambda x: abs(x[1]::DOUBLE - x[2]) <= 1e-6 + 1e-5 * abs(x[2]))) AS close, round(list_max(list_transform(list_zip(a, b), lambda x: abs(x[1]::DOUBLE - x[2]))), 6) AS max_difference FROM ({_SHIFTED})""")
def allclose_audit(spark, d):
    c = vectors.allclose(F.col("a"), F.col("b"))
    return _shifted(spark, d).select("vec_id", c["close"].alias("close"), r6(c["max_difference"]).alias("max_difference"))


@query(f"""SELECT label, CAST(count(*) AS BIGINT) AS pairs, round(avg(list_sum(list_transform(list_zip(a, b), lambda x: pow(x[1]::DOUBLE - x[2], 2))) / len(a)), 5) AS mse, CAST(0 AS BIGINT) AS not_finite FROM ({_SHIFTED}) GROUP BY 1""")
def patch_alignment(spark, d):
    return vectors.alignment(_shifted(spark, d), "label", "a", "b").select("label", "pairs", F.round("mse", 5).alias("mse"), "not_finite")


@query(f"SELECT event_type, epoch, round(v - lag(v) OVER w, 4) AS from_previous, round(v - min(v) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS from_best FROM ({_DAYS}) WINDOW w AS (PARTITION BY event_type ORDER BY epoch)")
def epoch_deltas(spark, d):
    return history.deltas(_days(spark, d), ["event_type"], "epoch", "v").select("event_type", "epoch", F.round("from_previous", 4).alias("from_previous"), F.round("from_best", 4).alias("from_best"))


@query(f"""WITH s AS (SELECT event_type, epoch, v, row_number() OVER w AS i, min(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_DAYS}) WINDOW w AS (PARTITION BY event_type ORDER BY epoch)),
  c AS (SELECT *, i - max(CASE WHEN before IS NULL OR v < before - 0.5 OR i <= 5 THEN i END) OVER (PARTITION BY event_type ORDER BY i) AS since FROM s),
  e AS (SELECT *, min(CASE WHEN i >= 5 AND since >= 10 THEN i END) OVER (PARTITION BY event_type) AS stop FROM c),
  t AS (SELECT *, first_value(v) OVER x - v AS change, regr_slope(v, i) OVER x AS slope FROM e WHERE stop IS NULL OR i <= stop WINDOW x AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  SELECT event_type, CAST(count(*) AS BIGINT) AS steps, arg_min(epoch, (v, epoch)) AS best_step, min(v) AS best_value, CASE WHEN max(stop) IS NOT NULL THEN '{history.PATIENCE}' WHEN arg_max(change, i) > 0.5 AND arg_max(slope, i) < 0 THEN '{history.IMPROVING}' ELSE '{history.PLATEAU}' END AS reason FROM t GROUP BY 1""")
def stop_reason(spark, d):
    return history.stop_reason(_days(spark, d), ["event_type"], "epoch", "v", 5, 10, 0.5)


@query("SELECT event_type, round(sum(value * (user_id % 7)) / sum(user_id % 7)::DOUBLE, 5) AS weighted_mean, CAST(sum(user_id % 7) AS BIGINT) AS weight FROM events GROUP BY 1")
def weighted_epoch_mean(spark, d):
    return history.weighted_mean(table(spark, d, "events").withColumn("w", F.col("user_id") % 7), ["event_type"], "value", "w").select("event_type", F.round("weighted_mean", 5).alias("weighted_mean"), "weight")


@query(f"""SELECT event_type, CAST(count(*) AS BIGINT) AS steps, CAST(sum(epoch % 5 + 1) AS BIGINT) AS seconds, CAST(max(epoch % 9) AS BIGINT) AS memory, round(avg(1.0::DOUBLE / (epoch % 5 + 1)), 6) AS rate, arg_max(epoch, (v, -epoch)) AS best_step, max(v) AS best_score FROM ({_DAYS}) GROUP BY 1""")
def training_efficiency(spark, d):
    runs = _days(spark, d).withColumns({"seconds": F.col("epoch") % 5 + 1, "memory": F.col("epoch") % 9})
    return history.efficiency(runs, ["event_type"], "epoch", "v", "seconds", "memory").withColumn("rate", r6("rate"))


@query("SELECT CAST(floor(event_id / 1000) AS BIGINT) AS batch, min(event_id) AS first, max(event_id) AS last, CAST(count(*) AS BIGINT) AS n, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std FROM events GROUP BY 1")
def batch_metrics(spark, d):
    return history.batch_metrics(table(spark, d, "events"), "event_id", "value", 1000).withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query("""SELECT name, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN x IS NOT DISTINCT FROM y THEN 'same' ELSE 'changed' END AS change FROM (SELECT doc_id AS name, true AS a, sha256(text) AS x FROM documents WHERE doc_id % 9 <> 0)
  FULL JOIN (SELECT doc_id AS name, true AS b, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS y FROM documents WHERE doc_id % 8 <> 0) USING (name)""")
def artifact_changes(spark, d):
    docs = table(spark, d, "documents")
    before = docs.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("sha"))
    after = docs.where("doc_id % 8 <> 0").select(F.col("doc_id").alias("name"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha"))
    return validate.changes(before, after, "name", "sha")


@query("SELECT CAST(k AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def json_props(spark, d):
    """How often each key stands at the top of the events' properties."""
    return table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT CAST(quality + toxic AS BIGINT) AS labels, CAST(count(*) AS BIGINT) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM labels), 6) AS percent FROM labels GROUP BY 1")
def label_cardinality(spark, d):
    rows = table(spark, d, "labels").select((F.col("quality") + F.col("toxic")).cast("long").alias("labels"))
    total = rows.agg(F.count("*").alias("t"))
    return rows.groupBy("labels").agg(F.count("*").alias("n")).crossJoin(total).select("labels", "n", r6(100.0 * F.col("n") / F.col("t")).alias("percent"))


@query()
def evidence(spark, d):
    """What the differences of two models support, from the intervals of 10,000 replicates; tested on fixed intervals."""
    from cairn.plans.models import bootstrap_metrics_ci

    ci = bootstrap_metrics_ci(spark, d)
    return ci.withColumn("conclusion", compare.conclusion(F.col("low"), F.col("high"), F.col("mean")))
