"""All queries over the driver's tables, each with the SQL that a second engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import cols
from cairn.operators import graph, history, metrics, relate, resampling, samples, splits, validate
from cairn.plans.tables import BOXES, PREDICTIONS, SPLIT_DOCS, boxes, predictions, split_docs, table

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _register() -> None:
    from cairn.plans import audits, inventory, models, records, reviews, scans, sets  # noqa: F401  their queries register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _register()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _register()
    return dict(_sql)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


LANGS, SPLITS = ["de", "en", "es", "fr"], ["test", "train", "val"]
_Z = "(VALUES ('train'), ('val'), ('test')) s(split), (VALUES ('de'), ('en'), ('es'), ('fr')) l(lang)"


@query(f"SELECT doc_id, split FROM ({SPLIT_DOCS})")
def split_assign(spark, d):
    return split_docs(spark, d).select("doc_id", "split")


@query(f"""SELECT s.split, l.lang, CAST(count(x.doc_id) AS BIGINT) AS n, CAST(count(DISTINCT x.source) AS BIGINT) AS sources
  FROM {_Z} LEFT JOIN ({SPLIT_DOCS}) x ON x.split = s.split AND x.lang = l.lang GROUP BY 1, 2""")
def split_class_grid(spark, d):
    counts = split_docs(spark, d).groupBy("split", "lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    return relate.grid(counts, {"split": SPLITS, "lang": LANGS}, ["n", "sources"])


@query(f"SELECT sha AS value, string_agg(DISTINCT split, ';' ORDER BY split) AS splits FROM ({SPLIT_DOCS}) WHERE sha IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leakage_by_field(spark, d):
    return relate.crossing(split_docs(spark, d), "sha")


def _leak(f: str) -> str:
    return f"""SELECT '{f}' AS audit_name, CAST(count(*) AS BIGINT) AS leakage_count, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
      coalesce(string_agg(v, ';' ORDER BY v) FILTER (WHERE i <= 20), '') AS details FROM (SELECT v, row_number() OVER (ORDER BY v) AS i
      FROM (SELECT CAST({f} AS VARCHAR) AS v FROM ({SPLIT_DOCS}) WHERE {f} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1))"""


@query(" UNION ALL ".join(_leak(f) for f in ("doc_id", "sha", "source")))
def leakage_audit(spark, d):
    return relate.leakage_audit(split_docs(spark, d), ["doc_id", "sha", "source"])


@query("""SELECT sha256(text) AS sha, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source) AS BIGINT) AS sources, string_agg(CAST(doc_id AS VARCHAR), ';' ORDER BY doc_id) AS doc_ids, count(DISTINCT source) > 1 AS is_cross_source
  FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def dup_sha_groups(spark, d):
    g = split_docs(spark, d).where("sha IS NOT NULL").groupBy("sha").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return g.where("n > 1").select("sha", "n", "sources", F.array_join(F.transform("ids", lambda x: x.cast("string")), ";").alias("doc_ids"), (F.col("sources") > 1).alias("is_cross_source"))


@query("""WITH a AS (SELECT 'documents' AS part, sha256(text) AS sha FROM documents UNION ALL SELECT 'benchmark', sha256(text) FROM benchmark UNION ALL SELECT 'conversations', sha256(text) FROM conversations)
  SELECT sha, CAST(count(*) FILTER (WHERE part = 'documents') AS BIGINT) AS documents, CAST(count(*) FILTER (WHERE part = 'benchmark') AS BIGINT) AS benchmark, CAST(count(*) FILTER (WHERE part = 'conversations') AS BIGINT) AS conversations, count(DISTINCT part) > 1 AS is_cross
  FROM a WHERE sha IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def cross_set_sha_groups(spark, d):
    parts = ["documents", "benchmark", "conversations"]
    rows = None
    for p in parts:
        one = table(spark, d, p).select(F.lit(p).alias("part"), F.sha2("text", 256).alias("sha"))
        rows = one if rows is None else rows.unionByName(one)
    g = rows.where("sha IS NOT NULL").groupBy("sha").agg(*(F.count_if(F.col("part") == p).alias(p) for p in parts), F.count("*").alias("_n"), (F.countDistinct("part") > 1).alias("is_cross"))
    return g.where("_n > 1").drop("_n")


@query("""SELECT o_orderkey, row_number() OVER w > 1 AS is_duplicate, CASE WHEN row_number() OVER w > 1 THEN first(o_orderkey) OVER w END AS duplicate_of
  FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderkey)""")
def first_occurrence_dedup(spark, d):
    return relate.first_of(table(spark, d, "orders"), ["o_custkey", "o_orderpriority", "o_orderstatus"], "o_orderkey").select("o_orderkey", "is_duplicate", "duplicate_of")


_REASON = f"""SELECT *, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 'non_positive_bbox_area' WHEN x1 <= 0 OR y1 <= 0 OR x0 >= w OR y0 >= h THEN 'bbox_completely_outside_image'
  WHEN greatest(0, cw) = 0 OR greatest(0, ch) = 0 THEN 'empty_after_clamp' ELSE '' END AS reason FROM (SELECT *, r - l AS cw, b - t AS ch FROM (SELECT *, CAST(floor(greatest(0.0, least(x0, w - 1.0))) AS BIGINT) AS l,
  CAST(floor(greatest(0.0, least(y0, h - 1.0))) AS BIGINT) AS t, CAST(ceil(greatest(1.0, least(x1, w))) AS BIGINT) AS r, CAST(ceil(greatest(1.0, least(y1, h))) AS BIGINT) AS b FROM ({BOXES})))"""


def _reasons(spark, d):
    b = boxes(spark, d)
    args = [F.col(c) for c in ("x0", "y0", "x1", "y1", "w", "h")]
    return b.withColumn("reason", cols.box_reason(*args)).withColumn("needs_clamp", cols.needs_clamp(*args)).withColumns(cols.clamp_box(*args))


@query(f"SELECT l_orderkey, l_linenumber, reason, x0 < 0 OR y0 < 0 OR x1 > w OR y1 > h AS needs_clamp FROM ({_REASON})")
def bbox_reason(spark, d):
    return _reasons(spark, d).select("l_orderkey", "l_linenumber", "reason", "needs_clamp")


@query(f'SELECT l_orderkey, l_linenumber, l AS "left", t AS top, r AS "right", b AS bottom, greatest(0, cw) AS crop_width, greatest(0, ch) AS crop_height FROM ({_REASON}) WHERE reason = \'\'')
def bbox_clamp(spark, d):
    return _reasons(spark, d).where("reason = ''").select("l_orderkey", "l_linenumber", "left", "top", "right", "bottom", F.col("crop_width").cast("long").alias("crop_width"), F.col("crop_height").cast("long").alias("crop_height"))


@query(f"""SELECT l_returnflag, reason, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders, CAST(min(greatest(0, cw)) AS BIGINT) AS min_width, CAST(max(greatest(0, cw)) AS BIGINT) AS max_width,
  round(avg(greatest(0, cw)), 6) AS mean_width FROM ({_REASON}) GROUP BY 1, 2""")
def bbox_summary(spark, d):
    w = F.col("crop_width").cast("long")
    return _reasons(spark, d).groupBy("l_returnflag", "reason").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.min(w).alias("min_width"), F.max(w).alias("max_width"), r6(F.avg(w)).alias("mean_width"))


@query("""SELECT a.l_orderkey, a.l_partkey, a.l_linenumber AS left_l_linenumber, b.l_linenumber AS right_l_linenumber, a.l_returnflag AS left_l_returnflag, b.l_returnflag AS right_l_returnflag
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_returnflag <> b.l_returnflag""")
def same_key_conflicts(spark, d):
    return relate.conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], "l_linenumber", ["l_returnflag"])


@query("""WITH r AS (SELECT conv_id AS k, count(DISTINCT trim(coalesce(role, '')) || '|' || coalesce(CAST(length(text) % 2 AS VARCHAR), '')) AS kinds, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1),
  t AS (SELECT DISTINCT conv_id AS k FROM conversations WHERE role = 'user')
  SELECT coalesce(t.k, r.k) AS conv_id, CASE WHEN t.k IS NULL THEN 'unmatched' WHEN r.k IS NULL THEN 'missing' WHEN kinds = 1 THEN 'matched' ELSE 'conflicting' END AS outcome, CAST(coalesce(n, 0) AS BIGINT) AS reviews
  FROM t FULL JOIN r ON t.k = r.k""")
def review_reconcile(spark, d):
    """Conversations in which a user asks, against all turns of assistants."""
    c = table(spark, d, "conversations").withColumn("odd", (F.length("text") % 2).cast("string"))
    return relate.reconcile(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id", ["role", "odd"])


@query("""SELECT a.o_orderkey, concat_ws(';', CASE WHEN a.o_orderstatus <> b.s THEN 'o_orderstatus' END, CASE WHEN a.o_custkey <> b.c THEN 'o_custkey' END) AS fields
  FROM orders a JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey END AS c FROM orders) b USING (o_orderkey) WHERE a.o_orderstatus <> b.s OR a.o_custkey <> b.c""")
def manifest_mismatch(spark, d):
    o = table(spark, d, "orders")
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 == 0, -1).otherwise(F.col("o_custkey")))
    return relate.mismatches(o, changed, "o_orderkey", ["o_orderstatus", "o_custkey"])


@query("""SELECT CAST(doc_id AS VARCHAR) AS key, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def expected_vs_actual(spark, d):
    return relate.missing_and_unexpected(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query("""SELECT CASE grouping(role, turn) WHEN 0 THEN 'role_turn' WHEN 1 THEN 'role' ELSE 'turn' END AS summary_type, coalesce(role, 'ALL') AS role, coalesce(CAST(turn AS VARCHAR), 'ALL') AS turn, CAST(count(*) AS BIGINT) AS n
  FROM conversations GROUP BY GROUPING SETS ((role), (turn), (role, turn))""")
def grouping_sets_review(spark, d):
    c = table(spark, d, "conversations").withColumn("turn", F.col("turn").cast("string"))
    g = c.groupingSets([["role"], ["turn"], ["role", "turn"]], "role", "turn").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    kind = F.when(F.col("g") == 0, "role_turn").when(F.col("g") == 1, "role").otherwise("turn")
    return g.select(kind.alias("summary_type"), F.coalesce("role", F.lit("ALL")).alias("role"), F.coalesce("turn", F.lit("ALL")).alias("turn"), "n")


@query(f"SELECT split, CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM ({SPLIT_DOCS}) GROUP BY GROUPING SETS ((split), (split, lang))")
def rollup_roi_counts(spark, d):
    """Documents without a language are a row of their own (null), beside the sum of the split."""
    g = split_docs(spark, d).groupingSets([["split"], ["split", "lang"]], "split", "lang").agg(F.grouping("lang").alias("g"), F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    return g.select("split", F.when(F.col("g") == 1, "ALL").otherwise(F.col("lang")).alias("lang"), "n", "sources")


_IDS = "list_filter([CASE WHEN quality = 1 THEN 0 END, CASE WHEN toxic = 1 THEN 1 END], lambda x: x IS NOT NULL)"


def _labelled(spark, d):
    ids = F.array_compact(F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1)))
    return table(spark, d, "labels").withColumn("ids", ids).withColumn("vector", cols.label_vector(F.col("ids"), 2))


@query(f"SELECT doc_id, '[' || quality || ',' || toxic || ']' AS label_vector, array_to_string({_IDS}, '|') AS positive_ids, CAST(quality + toxic AS BIGINT) AS num_positive FROM labels")
def label_vector(spark, d):
    ids = F.transform("ids", lambda x: x.cast("string"))
    return _labelled(spark, d).select("doc_id", cols.vector_text(F.col("vector")).alias("label_vector"), F.array_join(ids, "|").alias("positive_ids"), F.size("ids").cast("long").alias("num_positive"))


@query("SELECT CAST(quality + toxic AS BIGINT) AS cardinality, CAST(quality AS VARCHAR) || CAST(toxic AS VARCHAR) AS label_code, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY 1, 2")
def label_combinations(spark, d):
    return _labelled(spark, d).groupBy(F.size("ids").cast("long").alias("cardinality"), F.array_join(F.transform("vector", lambda x: x.cast("string")), "").alias("label_code")).agg(F.count("*").alias("n"))


@query("SELECT CAST(c AS INT) AS class_id, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, 0 AS c FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 1 FROM labels WHERE toxic = 1) GROUP BY 1")
def class_inverted_index(spark, d):
    return _labelled(spark, d).select("doc_id", F.explode("ids").alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_label' WHEN quality + toxic = 0 THEN 'no_valid_label' WHEN quality + toxic > 1 THEN 'multi_label' ELSE 'included' END AS final_status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def single_label_disposition(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(_labelled(spark, d), "doc_id", "left")
    n = F.size("ids")
    return j.select("doc_id", F.when(F.col("ids").isNull(), "missing_label").when(n == 0, "no_valid_label").when(n > 1, "multi_label").otherwise("included").alias("final_status"))


@query(f"""SELECT split, lang, doc_id, CAST(i AS INT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY split, lang ORDER BY sha256('42:' || doc_id), doc_id) AS i FROM ({SPLIT_DOCS})) WHERE i <= 10""")
def stratified_sample(spark, d):
    return samples.stratified(split_docs(spark, d), ["split", "lang"], "doc_id", 10).select("split", "lang", "doc_id", "pick")


@query(f"SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY lang, doc_id) - 1 AS record_index FROM ({SPLIT_DOCS})")
def dense_index(spark, d):
    return relate.numbered(split_docs(spark, d).select("doc_id", "lang", "split"), ["split"], ["lang", "doc_id"], "record_index").select("doc_id", "split", "record_index")


_CELLS = f"SELECT t.c AS truth, p.c AS predicted, CAST(count(x.vec_id) AS BIGINT) AS n FROM range(10) t(c) CROSS JOIN range(10) p(c) LEFT JOIN ({PREDICTIONS}) x ON x.truth = t.c AND x.predicted = p.c GROUP BY 1, 2"


@query(f"SELECT CAST(truth AS INT) AS truth, CAST(predicted AS INT) AS predicted, n FROM ({_CELLS})")
def confusion_matrix(spark, d):
    return metrics.confusion(predictions(spark, d), 10)


_CLASSES = f"""SELECT class_id, tp, called - tp AS fp, support - tp AS fn, total - called - support + tp AS tn, support, CASE WHEN called = 0 THEN 0.0 ELSE tp / called::DOUBLE END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp / support::DOUBLE END AS recall,
  CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (called + support) END AS f1 FROM (SELECT k.c AS class_id, CAST(count(*) FILTER (WHERE truth = k.c AND predicted = k.c) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE truth = k.c) AS BIGINT) AS support,
  CAST(count(*) FILTER (WHERE predicted = k.c) AS BIGINT) AS called, CAST(count(*) AS BIGINT) AS total FROM range(10) k(c) CROSS JOIN ({PREDICTIONS}) GROUP BY 1)"""


@query(f"SELECT CAST(class_id AS INT) AS class_id, tp, fp, fn, tn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({_CLASSES})")
def per_class_prf(spark, d):
    out = metrics.per_class(metrics.confusion(predictions(spark, d), 10))
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(f"SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM ({_CLASSES})")
def overall_metrics(spark, d):
    out = metrics.overall(metrics.per_class(metrics.confusion(predictions(spark, d), 10)))
    return out.select(*(r6(c).alias(c) for c in out.columns))


def _versus(spark, d):
    k = spark.range(10).select(F.col("id").cast("int").alias("class_id"))
    return predictions(spark, d).crossJoin(F.broadcast(k)).withColumn("y", (F.col("truth") == F.col("class_id")).cast("int"))


def _areas(spark, d, column, name="auroc"):
    """A row for each class, also for one that no row has."""
    found = metrics.one_against_rest(predictions(spark, d), "score", "truth", "vec_id").select(F.col("class").cast("int").alias("class_id"), r6(column).alias(name))
    return spark.range(10).select(F.col("id").cast("int").alias("class_id")).join(found, "class_id", "left")


_VERSUS = f"SELECT k.c AS class_id, vec_id, score, CAST(truth = k.c AS INT) AS y FROM ({PREDICTIONS}) CROSS JOIN range(10) k(c)"


@query(f"""SELECT CAST(class_id AS INT) AS class_id, round(sum(CASE WHEN y = 0 THEN tp END)::DOUBLE / (sum(y) * sum(1 - y)), 6) AS auroc FROM (SELECT *, sum(y) OVER (PARTITION BY class_id ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING) AS tp FROM ({_VERSUS})) GROUP BY 1""")
def auroc_stable(spark, d):
    return _areas(spark, d, "auroc_stable")


_STEPS = f"SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS called FROM (SELECT class_id, score, sum(y) AS pos, sum(1 - y) AS neg FROM ({_VERSUS}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY class_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT CAST(class_id AS INT) AS class_id, round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS auroc FROM ({_STEPS}) GROUP BY 1")
def auroc_tied(spark, d):
    return _areas(spark, d, "auroc")


@query(f"SELECT CAST(class_id AS INT) AS class_id, round(sum(pos * tp / called::DOUBLE) / sum(pos), 6) AS average_precision FROM ({_STEPS}) GROUP BY 1")
def average_precision(spark, d):
    return _areas(spark, d, "average_precision", "average_precision")


@query(f"""WITH c AS (SELECT class_id, t / 100.0::DOUBLE AS threshold, sum(CASE WHEN score >= t / 100.0::DOUBLE THEN y ELSE 0 END) AS tp, sum(CASE WHEN score >= t / 100.0::DOUBLE THEN 1 ELSE 0 END) AS called, sum(y) AS support FROM ({_VERSUS}) CROSS JOIN range(5, 96) g(t) GROUP BY 1, 2),
  f AS (SELECT *, CASE WHEN called + support = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (called + support) END AS f1 FROM c)
  SELECT CAST(class_id AS INT) AS class_id, threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY f1 DESC, abs(threshold - 0.5), threshold) AS i FROM f) WHERE i = 1""")
def threshold_search(spark, d):
    return metrics.threshold_search(_versus(spark, d), "score", "y", ("class_id",)).withColumn("f1", r6("f1"))


@query(f"""SELECT vec_id, CAST(sum(t * p) AS BIGINT) AS tp, CAST(sum((1 - t) * p) AS BIGINT) AS fp, CAST(sum(t * (1 - p)) AS BIGINT) AS fn, CAST(sum((1 - t) * (1 - p)) AS BIGINT) AS tn, coalesce(string_agg(CASE WHEN t = 1 AND p = 0 THEN k END, ';' ORDER BY k), '') AS missed, coalesce(string_agg(CASE WHEN t = 0 AND p = 1 THEN k END, ';' ORDER BY k), '') AS extra,
  sum(abs(t - p)) = 0 AS exact_match, round(CASE WHEN sum(t * p) = 0 THEN 0.0 ELSE 2.0::DOUBLE * sum(t * p) / (sum(t) + sum(p)) END, 6) AS f1
  FROM (SELECT vec_id, k, CAST(k = truth OR k = other AS INT) AS t, CAST(k = predicted OR k = truth AS INT) AS p FROM ({PREDICTIONS}) CROSS JOIN range(10) q(k)) GROUP BY 1""")
def sample_metrics(spark, d):
    p = predictions(spark, d)
    m = metrics.sample_metrics(cols.label_vector(F.array("truth", "other"), 10), cols.label_vector(F.array("predicted", "truth"), 10))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
    return p.select("vec_id", *(m[x].cast("long").alias(x) for x in ("tp", "fp", "fn", "tn")), text(m["missed"]).alias("missed"), text(m["extra"]).alias("extra"), m["exact_match"].alias("exact_match"), r6(m["f1"]).alias("f1"))


_MULTI = f"SELECT k, CAST(k = truth OR k = other AS INT) AS t, CAST(k = predicted OR k = truth AS INT) AS p, vec_id FROM ({PREDICTIONS}) CROSS JOIN range(10) q(k)"


@query(f"""WITH m AS ({_MULTI}), c AS (SELECT k, sum(t * p) AS tp, sum(t) AS s, sum(p) AS q FROM m GROUP BY 1), r AS (SELECT vec_id, sum(abs(t - p)) AS wrong FROM m GROUP BY 1)
  SELECT (SELECT round(2.0::DOUBLE * sum(tp) / (sum(s) + sum(q)), 6) FROM c) AS micro_f1, (SELECT round(avg(CASE WHEN s + q = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (s + q) END), 6) FROM c) AS macro_f1, (SELECT round(avg(wrong / 10.0::DOUBLE), 6) FROM r) AS hamming, (SELECT round(avg(CASE WHEN wrong = 0 THEN 1.0 ELSE 0.0 END), 6) FROM r) AS subset_accuracy""")
def multilabel_metrics(spark, d):
    out = metrics.multilabel_summary(predictions(spark, d), cols.label_vector(F.array("truth", "other"), 10), cols.label_vector(F.array("predicted", "truth"), 10), 10)
    return out.select(*(r6(x).alias(x) for x in out.columns))


@query(f"SELECT CAST(truth AS INT) AS truth, round(avg(-ln(greatest(least(score, 1.0), 1e-300))), 6) AS log_loss FROM ({PREDICTIONS}) GROUP BY 1")
def log_loss(spark, d):
    """Over all predictions, those of probability 0 at the clip."""
    return predictions(spark, d).groupBy(F.col("truth").cast("int").alias("truth")).agg(r6(metrics.log_loss(F.col("score"))).alias("log_loss"))


_AGREE = {"both_correct": "predicted = truth AND other = truth", "first_only": "predicted = truth AND other <> truth", "second_only": "predicted <> truth AND other = truth", "both_wrong": "predicted <> truth AND other <> truth", "agree": "predicted = other", "both_wrong_same": "predicted <> truth AND predicted = other"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS predicate, CAST(count(*) FILTER (WHERE {v}) AS BIGINT) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE {v}) / count(*), 6) AS percent FROM ({PREDICTIONS})" for k, v in _AGREE.items()))
def paired_agreement(spark, d):
    one = predictions(spark, d).agg(F.count("*").alias("total"), *(F.count_if(F.expr(v)).alias(k) for k, v in _AGREE.items()))
    return one.unpivot("total", list(_AGREE), "predicate", "n").select("predicate", "n", r6(100.0 * F.col("n") / F.col("total")).alias("percent"))


@query(f"SELECT b, c, round(CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2) / (b + c)::DOUBLE END, 6) AS chi2 FROM (SELECT CAST(count(*) FILTER (WHERE {_AGREE['first_only']}) AS BIGINT) AS b, CAST(count(*) FILTER (WHERE {_AGREE['second_only']}) AS BIGINT) AS c FROM ({PREDICTIONS}))")
def mcnemar_counts(spark, d):
    n = predictions(spark, d).agg(F.count_if(F.expr(_AGREE["first_only"])).alias("b"), F.count_if(F.expr(_AGREE["second_only"])).alias("c"))
    return n.withColumn("chi2", r6(cols.ratio(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)), F.col("b") + F.col("c"))))


#: The two-sided tail term by term, which a second engine can do for the counts of these tables.
_TAIL = "round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE))))), 9)"


@query(f"SELECT b, c, round(CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2) / (b + c)::DOUBLE END, 6) AS chi2, {_TAIL} AS p FROM (SELECT CAST(count(*) FILTER (WHERE {_AGREE['first_only']}) AS BIGINT) AS b, CAST(count(*) FILTER (WHERE {_AGREE['second_only']}) AS BIGINT) AS c FROM ({PREDICTIONS}))")
def mcnemar_exact(spark, d):
    return mcnemar_counts(spark, d).withColumn("p", F.round(metrics.exact_tail(F.col("b"), F.col("c")), 9))


@query("""WITH t AS (SELECT event_type AS name, (count(*) % 97) / 1000.0::DOUBLE AS p FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM t)
  SELECT name, round(p, 6) AS p, round(adjusted, 6) AS adjusted, adjusted < 0.05 AS rejected FROM (SELECT name, p, least(1.0, max((m - i + 1) * p) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS adjusted FROM r)""")
def holm_adjust(spark, d):
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(((F.count("*") % 97) / F.lit(1000.0)).alias("p"))
    return metrics.holm(t).withColumns({"p": r6("p"), "adjusted": r6("adjusted")})


@query(f"SELECT CAST(t.c AS INT) AS truth, CAST(p.c AS INT) AS predicted, CAST(count(x.vec_id) AS BIGINT) AS n FROM range(10) t(c) CROSS JOIN range(10) p(c) LEFT JOIN ({PREDICTIONS}) x ON x.predicted = t.c AND x.other = p.c GROUP BY 1, 2")
def transition_matrix(spark, d):
    return metrics.confusion(predictions(spark, d), 10, "predicted", "other")


@query(f"SELECT CAST(truth AS INT) AS truth, CAST(predicted AS INT) AS predicted, round(CASE WHEN sum(n) OVER (PARTITION BY truth) = 0 THEN 0.0 ELSE n / (sum(n) OVER (PARTITION BY truth))::DOUBLE END, 6) AS share FROM ({_CELLS})")
def row_normalized_confusion(spark, d):
    c = metrics.confusion(predictions(spark, d), 10)
    return c.select("truth", "predicted", r6(cols.ratio(F.col("n"), F.sum("n").over(W.partitionBy("truth")))).alias("share"))


@query("""SELECT direction, vec_id, CAST(i AS INT) AS rank, round(delta, 6) AS delta FROM (SELECT 'increase' AS direction, vec_id, delta, row_number() OVER (ORDER BY delta DESC, vec_id) AS i FROM (SELECT vec_id, embedding[1]::DOUBLE - embedding[2]::DOUBLE AS delta FROM embeddings)
  UNION ALL SELECT 'decrease', vec_id, delta, row_number() OVER (ORDER BY delta, vec_id) FROM (SELECT vec_id, embedding[1]::DOUBLE - embedding[2]::DOUBLE AS delta FROM embeddings)) WHERE i <= 25""")
def confidence_topk(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", (F.get("embedding", 0).cast("double") - F.get("embedding", 1).cast("double")).alias("delta"))
    out = None
    for name, order in (("increase", F.desc("delta")), ("decrease", F.asc("delta"))):
        # The limit is applied in every task first, so the ranking sees 25 rows.
        top = rows.orderBy(order, "vec_id").limit(25).select(F.lit(name).alias("direction"), "vec_id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order, "vec_id")).alias("rank"), r6("delta").alias("delta"))
        out = top if out is None else out.unionByName(top)
    return out


@query("""SELECT CAST(label AS INT) AS label, CAST(count(*) AS BIGINT) AS values_n, round(min(x), 5) AS low, round(max(x), 5) AS high, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1""")
def vector_stats(spark, d):
    x = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("values_n"), F.round(F.min("x"), 5).alias("low"), F.round(F.max("x"), 5).alias("high"), F.round(F.avg("x"), 5).alias("mean"), F.round(F.stddev_pop("x"), 5).alias("std"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT label, arg_min(v, vec_id) AS u FROM e GROUP BY 1)
  SELECT vec_id, round(list_cosine_similarity(v, u), 5) AS cosine FROM e JOIN r USING (label)""")
def vector_cosine(spark, d):
    e = table(spark, d, "embeddings")
    ref = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("u"))
    v, u = F.col("embedding"), F.col("u")
    return e.join(ref, "label").select("vec_id", F.round(cols.dot(v, u) / (cols.l2(v) * cols.l2(u)), 5).alias("cosine"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT vec_id) AS BIGINT) AS distinct_n, min(vec_id) AS low, max(vec_id) AS high, count(*) = count(DISTINCT vec_id) AND min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AS contiguous FROM embeddings")
def index_contiguity(spark, d):
    a = table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("distinct_n"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))
    return a.withColumn("contiguous", F.expr("n = distinct_n AND low = 0 AND high = n - 1"))


_DAYS = "SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch, round(avg(value), 4) AS v FROM events GROUP BY 1, 2"


def _days(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("epoch")).agg(cols.round_binary(F.avg("value"), 4).alias("v"))


@query(f"SELECT event_type, epoch, v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, epoch) AS i FROM ({_DAYS})) WHERE i = 1")
def best_epoch(spark, d):
    return history.best_row(_days(spark, d), ["event_type"], [F.desc("v"), F.asc("epoch")])


@query(f"""SELECT event_type, epoch, round(first_value(v) OVER w - v, 5) AS change_5, round(CASE WHEN count(*) OVER w > 1 THEN regr_slope(v, epoch) OVER w ELSE 0.0 END, 5) AS slope_5 FROM ({_DAYS}) WINDOW w AS (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def trailing_slope(spark, d):
    r5 = lambda c: F.round(c, 5).cast("double").alias(c)
    return history.trailing(_days(spark, d), ["event_type"], "epoch", "v", 5).select("event_type", "epoch", r5("change_5"), r5("slope_5"))


@query(f"""WITH RECURSIVE s AS (SELECT event_type, epoch, v, row_number() OVER (PARTITION BY event_type ORDER BY epoch) AS i FROM ({_DAYS})),
  f AS (SELECT event_type, i, v AS best, 0 AS since FROM s WHERE i = 1 UNION ALL SELECT s.event_type, s.i, CASE WHEN s.v > f.best + 0.5 THEN s.v ELSE f.best END, CASE WHEN s.v > f.best + 0.5 THEN 0 ELSE f.since + 1 END FROM f JOIN s ON s.event_type = f.event_type AND s.i = f.i + 1)
  SELECT event_type, best AS reference, CAST(since AS BIGINT) AS steps_since FROM (SELECT *, max(i) OVER (PARTITION BY event_type) AS m FROM f) WHERE i = m""")
def early_stop(spark, d):
    return history.early_stopping(_days(spark, d), ["event_type"], "epoch", "v", 0.5)


@query("SELECT doc_id, w AS width, h AS height, CAST(rw AS INT) AS resized_width, CAST(rh AS INT) AS resized_height, CAST((224 - rw) // 2 AS INT) AS pad_left, CAST((224 - rh) // 2 AS INT) AS pad_top, CAST(224 - rw - (224 - rw) // 2 AS INT) AS pad_right, CAST(224 - rh - (224 - rh) // 2 AS INT) AS pad_bottom FROM (SELECT *, greatest(1, CAST(round_even(w * s, 0) AS INT)) AS rw, greatest(1, CAST(round_even(h * s, 0) AS INT)) AS rh FROM (SELECT *, least(224 / w::DOUBLE, 224 / h::DOUBLE) AS s FROM (SELECT doc_id, CAST(n_chars % 512 + 1 AS INT) AS w, CAST(n_chars % 333 + 1 AS INT) AS h FROM documents)))")
def letterbox_geometry(spark, d):
    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 512 + 1).cast("int").alias("width"), (F.col("n_chars") % 333 + 1).cast("int").alias("height"))
    return x.withColumns(cols.letterbox(F.col("width"), F.col("height"), 224))


@query("""WITH r AS (SELECT doc_id, sha256(text) AS sha, lang || n_chars AS name FROM documents), o AS (SELECT sha, min(doc_id) AS f FROM r WHERE sha IS NOT NULL GROUP BY 1 HAVING count(*) = 1), n AS (SELECT name, min(doc_id) AS f FROM r WHERE name IS NOT NULL GROUP BY 1)
  SELECT r.doc_id, coalesce(o.f, n.f) AS found, CASE WHEN o.sha IS NOT NULL THEN 'sha256' WHEN n.name IS NOT NULL THEN 'image_id' ELSE 'none' END AS method FROM r LEFT JOIN o ON r.sha = o.sha LEFT JOIN n ON r.name = n.name""")
def gt_lookup(spark, d):
    """All documents, looked up in the catalogue of all documents."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.concat("lang", F.col("n_chars").cast("string")).alias("name"))
    return relate.lookup(rows, rows.withColumnRenamed("doc_id", "value"), "sha", "name", "value").select("doc_id", "found", "method")


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/]+)(/[^?]*)?', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/]+)(/[^?]*)?', 2) AS host, lower(regexp_extract(url, '^([a-z]+)://([^/]+)(/[^?]*)?', 3)) AS path, CAST(len(string_split(html, '<p')) - 1 AS BIGINT) AS paragraphs FROM pages")
def path_parse(spark, d):
    p = r"^([a-z]+)://([^/]+)(/[^?]*)?"
    part = lambda i: F.regexp_extract("url", p, i)
    return table(spark, d, "pages").select("page_id", part(1).alias("scheme"), part(2).alias("host"), F.lower(part(3)).alias("path"), (F.size(F.split("html", "<p")) - 1).cast("long").alias("paragraphs"))


@query("SELECT r_name, n_name, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, CAST(count(o_orderkey) AS BIGINT) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def manifest_enrichment(spark, d):
    r, n, c, o = (table(spark, d, x) for x in ("region", "nation", "customer", "orders"))
    j = r.join(n, F.expr("n_regionkey = r_regionkey")).join(c, F.expr("c_nationkey = n_nationkey"), "left").join(o, F.expr("o_custkey = c_custkey"), "left")
    return j.groupBy("r_name", "n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT o_custkey AS node, l_partkey AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL), c AS (SELECT k, min(node) AS other FROM p WHERE k IS NOT NULL GROUP BY 1),
  s AS (SELECT node, other FROM p JOIN c USING (k) WHERE node <> other), e AS (SELECT node, other FROM s UNION SELECT other, node FROM s),
  r AS (SELECT DISTINCT node, node AS root FROM p UNION SELECT e.node, r.root FROM r JOIN e ON e.other = r.node WHERE r.root < e.node) SELECT node, min(root) AS root FROM r GROUP BY 1""")
def components(spark, d):
    """Customers of all orders, joined by the parts that they ordered."""
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("k"))
    return graph.shared_key_components(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("node")).join(parts, "o_orderkey", "left"), "node", "k")


_FLAGS = f"SELECT vec_id % 50 AS cluster, predicted = truth AS first_ok, other = truth AS second_ok FROM ({PREDICTIONS})"
_HASH = "CAST('0x' || substr(sha256('7:' || (rep * 1000 + i)), 1, 8) AS BIGINT) % 50"


@query(f"""WITH t AS (SELECT rep, {_HASH} AS cluster, count(*) AS times FROM range(200) r(rep) CROSS JOIN range(50) c(i) GROUP BY 1, 2), o AS (SELECT cluster, count(*) AS n, sum(CAST(first_ok AS INT)) AS a, sum(CAST(second_ok AS INT)) AS b FROM ({_FLAGS}) GROUP BY 1),
  x AS (SELECT rep, sum(b * times) / sum(n * times)::DOUBLE - sum(a * times) / sum(n * times)::DOUBLE AS v FROM t JOIN o USING (cluster) GROUP BY 1)
  SELECT CAST(count(*) AS BIGINT) AS valid, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS se, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(avg(CAST(v > 0 AS INT)), 6) AS p_above, round(avg(CAST(v < 0 AS INT)), 6) AS p_below, quantile_cont(v, 0.025) <= 0 AND quantile_cont(v, 0.975) >= 0 AS ci_includes_0 FROM x""")
def bootstrap_ci(spark, d):
    u = cols.hash_unit("7", F.col("rep") * 1000 + F.col("i"))
    drawn = spark.range(200).withColumnRenamed("id", "rep").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(49)))).groupBy("rep", F.pmod(u, F.lit(50)).alias("cluster")).agg(F.count("*").alias("times"))
    rows = predictions(spark, d).select((F.col("vec_id") % 50).alias("cluster"), (F.col("predicted") == F.col("truth")).alias("first_ok"), (F.col("other") == F.col("truth")).alias("second_ok"))
    out = resampling.summary(resampling.accuracy_difference(rows, "cluster", "first_ok", "second_ok", drawn))
    return out.withColumns({c: r6(c) for c in ("mean", "se", "low", "high", "p_above", "p_below")})


@query("SELECT lang, CAST(n AS BIGINT) AS n, CAST(round_even(n * 0.8::DOUBLE, 0) AS BIGINT) AS train, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT) AS val, CAST(n - round_even(n * 0.8::DOUBLE, 0) - round_even(n * 0.1::DOUBLE, 0) AS BIGINT) AS test FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def split_targets(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumns(splits.targets(F.col("n")))


@query()
def greedy_split(spark, d):
    """Twenty neighbouring documents of a source are a group; one without a source is a group of its own. Tested on quotas."""
    name = F.coalesce(F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 20).cast("string")), F.concat(F.lit("document/"), F.col("doc_id").cast("string")))
    return splits.grouped_split(table(spark, d, "documents").groupBy(name.alias("id")).agg(F.array_sort(F.collect_set("lang")).alias("labels")))


@query()
def repaired_split(spark, d):
    """The split of documents by a hash, moved to exactly 80, 10 and 10 of 100 with languages at their shares. Tested against the plain search."""
    docs = split_docs(spark, d).select(F.col("doc_id").alias("id"), F.array_compact(F.array("lang")).alias("labels"), "split")
    n = docs.count()
    want = dict(zip(splits.SPLITS, splits.quotas(n).tolist(), strict=True))
    return splits.repair_sizes(docs, want)


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity FROM lineitem), c AS (SELECT l_orderkey, l_partkey FROM b GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1)
  SELECT l_orderkey, l_linenumber, 'manual_fail' AS reason FROM b WHERE l_orderkey % 17 = 0 UNION SELECT l_orderkey, l_linenumber, 'class_conflict' FROM b JOIN c USING (l_orderkey, l_partkey) UNION SELECT l_orderkey, l_linenumber, 'low_quantity' FROM b WHERE l_quantity < 2""")
def exclusion_reasons(spark, d):
    b = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    conflict = validate.ambiguous_keys(b, ["l_orderkey", "l_partkey"], "l_returnflag").select("l_orderkey", "l_partkey")
    return validate.exclusions({"manual_fail": b.where("l_orderkey % 17 = 0"), "class_conflict": b.join(conflict, ["l_orderkey", "l_partkey"], "left_semi"), "low_quantity": b.where("l_quantity < 2")}, ["l_orderkey", "l_linenumber"])


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN l_orderkey % 17 = 0 THEN 'manual_fail' WHEN l_quantity < 2 THEN 'low_quantity' WHEN l_discount > 0.09 THEN 'discount' ELSE 'kept' END AS kind FROM lineitem) GROUP BY 1")
def exclusion_cascade(spark, d):
    return validate.cascade(table(spark, d, "lineitem"), {"manual_fail": F.col("l_orderkey") % 17 == 0, "low_quantity": F.col("l_quantity") < 2, "discount": F.col("l_discount") > 0.09})