"""Queries that compare three models over one table of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import cols
from cairn.operators import compare, metrics, relate, resampling
from cairn.plans.catalogue import _STEPS, _TAIL, _versus, _VERSUS, query, r6
from cairn.plans.tables import PREDICTIONS, predictions, table

MODELS = {"first": "predicted", "second": "other", "third": "third"}
THREE = f"SELECT *, CAST(CASE WHEN (vec_id * 6007) % 89 < 58 THEN truth ELSE (truth + (vec_id * 6007) % 89) % 10 END AS INT) AS third FROM ({PREDICTIONS})"


def three(spark, d):
    c = F.pmod(F.col("vec_id") * 6007, F.lit(89))
    return predictions(spark, d).withColumn("third", F.when(c < 58, F.col("truth")).otherwise(F.pmod(F.col("truth") + c, F.lit(10))).cast("int"))


def _classes(spark, d, model):
    return metrics.per_class(metrics.confusion(three(spark, d), 10, "truth", MODELS[model]))


def _overall(spark, d, model):
    return compare.long_metrics(metrics.overall(_classes(spark, d, model)))


def _by_class(model: str) -> str:
    p = MODELS[model]
    return f"""SELECT class_id, tp, called - tp AS fp, support - tp AS fn, support, CASE WHEN called = 0 THEN 0.0 ELSE tp / called::DOUBLE END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp / support::DOUBLE END AS recall,
      CASE WHEN tp = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (called + support) END AS f1 FROM (SELECT k.c AS class_id, count(*) FILTER (WHERE truth = k.c AND {p} = k.c) AS tp, count(*) FILTER (WHERE truth = k.c) AS support,
      count(*) FILTER (WHERE {p} = k.c) AS called FROM range(10) k(c) CROSS JOIN ({THREE}) GROUP BY 1)"""


_OVERALL = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"]


def _long(model: str) -> str:
    return f"""SELECT unnest(['accuracy', 'macro_precision', 'macro_recall', 'macro_f1', 'weighted_f1']) AS metric, unnest([sum(tp) / sum(support)::DOUBLE, avg(precision), avg(recall), avg(f1), sum(f1 * support) / sum(support)]) AS value FROM ({_by_class(model)})"""


@query(f"""SELECT metric, round(a.value, 6) AS first, round(b.value, 6) AS second, round(b.value - a.value, 6) AS difference, round(100 * (b.value - a.value) / a.value, 6) AS relative_percent,
  CASE WHEN abs(b.value - a.value) <= 1e-12 THEN 'tie' WHEN b.value > a.value THEN 'second' ELSE 'first' END AS better FROM ({_long('first')}) a JOIN ({_long('second')}) b USING (metric)""")
def overall_comparison(spark, d):
    out = compare.versus(_overall(spark, d, "first"), _overall(spark, d, "second"), [], ("first", "second"))
    return out.select("metric", *(r6(c).alias(c) for c in ("first", "second", "difference", "relative_percent")), "better")


@query(f"""SELECT metric, round(a.value, 6) AS first, round(b.value, 6) AS second, round(c.value, 6) AS third, concat_ws(';', CASE WHEN abs(a.value - top) <= 1e-12 THEN 'first' END, CASE WHEN abs(b.value - top) <= 1e-12 THEN 'second' END, CASE WHEN abs(c.value - top) <= 1e-12 THEN 'third' END) AS best
  FROM ({_long('first')}) a JOIN ({_long('second')}) b USING (metric) JOIN ({_long('third')}) c USING (metric), LATERAL (SELECT greatest(a.value, b.value, c.value) AS top)""")
def three_model_comparison(spark, d):
    out = compare.best_of({m: _overall(spark, d, m) for m in MODELS}, [])
    return out.select("metric", *(r6(c).alias(c) for c in MODELS), "best")


_PER_CLASS = "SELECT class_id, unnest(['precision', 'recall', 'f1', 'fp', 'fn']) AS metric, unnest([precision, recall, f1, fp::DOUBLE, fn::DOUBLE]) AS value FROM ({})"


@query(f"""SELECT CAST(class_id AS INT) AS class_id, metric, round(a.value, 6) AS first, round(b.value, 6) AS second, round(b.value - a.value, 6) AS difference,
  CASE WHEN abs(b.value - a.value) <= 1e-12 THEN 'tie' WHEN (b.value > a.value) = (metric NOT IN ('fp', 'fn')) THEN 'second' ELSE 'first' END AS better
  FROM ({_PER_CLASS.format(_by_class('first'))}) a JOIN ({_PER_CLASS.format(_by_class('second'))}) b USING (class_id, metric)""")
def per_class_comparison(spark, d):
    long = [compare.long_metrics(_classes(spark, d, m).select("class_id", "precision", "recall", "f1", "fp", "fn"), ["class_id"]) for m in ("first", "second")]
    out = compare.versus(*long, ["class_id"], ("first", "second"), ("fp", "fn"))
    return out.select("class_id", "metric", *(r6(c).alias(c) for c in ("first", "second", "difference")), "better")


@query(f"""SELECT coalesce(a.metric, b.metric) AS metric, reported, round(b.value, 6) AS recomputed, coalesce(abs(reported - b.value) <= 5e-5, false) AS holds
  FROM (SELECT metric, CASE WHEN metric = 'macro_f1' THEN round(value, 4) + 0.01 ELSE round(value, 4) END AS reported FROM ({_long('first')}) WHERE metric <> 'accuracy') a FULL JOIN ({_long('first')}) b ON a.metric = b.metric""")
def metric_integrity(spark, d):
    """Values rounded to four places, one of them wrong and one absent, against what the predictions give."""
    own = _overall(spark, d, "first")
    told = own.where("metric <> 'accuracy'").withColumn("value", F.round("value", 4) + F.when(F.col("metric") == "macro_f1", 0.01).otherwise(0.0))
    return compare.integrity(told, own, 5e-5).select("metric", "reported", r6("recomputed").alias("recomputed"), "holds")


@query(f"""WITH c AS ({_by_class('first')}) SELECT CAST(class_id AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM c
  UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support)::DOUBLE, 6), NULL FROM c UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM c
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM c""")
def classification_report(spark, d):
    classes = _classes(spark, d, "first")
    return compare.report(classes, metrics.overall(classes)).withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(f"""SELECT CAST(t AS INT) AS truth, CAST(p AS INT) AS predicted, CAST(count(*) FILTER (WHERE predicted = p) AS BIGINT) AS n, round(count(*) FILTER (WHERE predicted = p) / count(*)::DOUBLE, 6) AS share FROM ({PREDICTIONS}) JOIN (VALUES (0, 1), (1, 0), (2, 3), (4, 9)) w(t, p) ON truth = t GROUP BY 1, 2""")
def confusion_cells(spark, d):
    return compare.cells(metrics.confusion(predictions(spark, d), 10), [(0, 1), (1, 0), (2, 3), (4, 9)]).withColumn("share", r6("share"))


_RIGHT = {m: f"{p} = truth" for m, p in MODELS.items()}
_PREDICATES = {f"{m}_right": c for m, c in _RIGHT.items()}
_PREDICATES |= {f"only_{m}_right": " AND ".join(c if m == n else f"NOT {c}" for n, c in _RIGHT.items()) for m in MODELS}
_PREDICATES |= {f"only_{m}_wrong": " AND ".join(f"NOT {c}" if m == n else c for n, c in _RIGHT.items()) for m in MODELS}
_PREDICATES |= {"first_second_agree": "predicted = other", "first_third_agree": "predicted = third", "second_third_agree": "other = third", "all_agree": "predicted = other AND other = third", "all_right": " AND ".join(_RIGHT.values()), "all_wrong": " AND ".join(f"NOT {c}" for c in _RIGHT.values())}


@query(" UNION ALL ".join(f"SELECT '{k}' AS predicate, CAST(count(*) FILTER (WHERE {v}) AS BIGINT) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE {v}) / count(*), 6) AS percent FROM ({THREE})" for k, v in _PREDICATES.items()))
def three_model_agreement(spark, d):
    return compare.predicates(three(spark, d), {k: F.expr(v) for k, v in _PREDICATES.items()}).withColumn("percent", r6("percent"))


_PAIRS = [("first", "second"), ("first", "third"), ("second", "third")]


_COUNTED = " UNION ALL ".join(f"SELECT '{a}_{b}' AS pair, b, c, round(CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2) / (b + c)::DOUBLE END, 6) AS chi2 FROM (SELECT CAST(count(*) FILTER (WHERE {_RIGHT[a]} AND NOT {_RIGHT[b]}) AS BIGINT) AS b, CAST(count(*) FILTER (WHERE {_RIGHT[b]} AND NOT {_RIGHT[a]}) AS BIGINT) AS c FROM ({THREE}))" for a, b in _PAIRS)


@query(_COUNTED)
def mcnemar_pairs(spark, d):
    return metrics.mcnemar_pairs(three(spark, d), "truth", {f"{a}_{b}": (MODELS[a], MODELS[b]) for a, b in _PAIRS}).withColumn("chi2", r6("chi2"))


@query(f"""WITH t AS (SELECT *, {_TAIL} AS p FROM ({_COUNTED})), o AS (SELECT *, row_number() OVER (ORDER BY p, pair) AS i FROM t), a AS (SELECT *, least(1.0, max((3 - i + 1) * p) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS adjusted FROM o)
  SELECT pair, b, c, chi2, p, round(adjusted, 9) AS adjusted, adjusted < 0.05 AS rejected FROM a""")
def mcnemar_pairs_exact(spark, d):
    """With exact two-sided tails and their step-down adjustment; tested against integer arithmetic too."""
    found = metrics.mcnemar_pairs(three(spark, d), "truth", {f"{a}_{b}": (MODELS[a], MODELS[b]) for a, b in _PAIRS}).withColumn("chi2", r6("chi2"))
    tested = metrics.holm(found.withColumn("p", F.round(metrics.exact_tail(F.col("b"), F.col("c")), 9)), "p", "pair")
    return tested.withColumn("adjusted", F.round("adjusted", 9))


def _a(model: str) -> str:
    step = {"first": "vec_id % 5 = 0", "second": "vec_id % 7 = 0", "third": "vec_id % 11 = 0"}[model]
    return f"SELECT CASE WHEN {step} THEN NULL WHEN vec_id % 29 = 5 THEN -vec_id ELSE vec_id END AS record_index, 'set' AS source, 'p/' || vec_id AS path, {MODELS[model]} AS predicted FROM ({THREE})"


def _model_rows(spark, d, model):
    step = {"first": 5, "second": 7, "third": 11}[model]
    return three(spark, d).select(F.when(F.col("vec_id") % step != 0, F.when(F.col("vec_id") % 29 == 5, -F.col("vec_id")).otherwise(F.col("vec_id"))).alias("record_index"), F.lit("set").alias("source"), F.concat(F.lit("p/"), "vec_id").alias("path"), F.col(MODELS[model]).alias("predicted"))


def _manifest(spark, d):
    return predictions(spark, d).where("vec_id % 23 <> 1").select(F.col("vec_id").alias("record_index"), F.lit("set").alias("source"), F.concat(F.lit("p/"), "vec_id").alias("path"), F.col("vec_id").alias("row"), "truth")


@query(f"""WITH m AS (SELECT vec_id AS record_index, 'set' AS source, 'p/' || vec_id AS path, vec_id AS "row", truth FROM ({PREDICTIONS}) WHERE vec_id % 23 <> 1)
  SELECT r.path, r.predicted, coalesce(a."row", b."row") AS "row", coalesce(a.truth, b.truth) AS truth, CASE WHEN a."row" IS NOT NULL THEN 'index' WHEN b."row" IS NOT NULL THEN 'fallback' ELSE 'none' END AS matched_by
  FROM ({_a('first')}) r LEFT JOIN m a ON a.record_index = r.record_index LEFT JOIN m b ON b.source = r.source AND b.path = r.path""")
def fallback_pairing(spark, d):
    return relate.by_fallback(_model_rows(spark, d, "first"), _manifest(spark, d), "record_index", ["source", "path"], ["row", "truth"]).select("path", "predicted", "row", "truth", "matched_by")


def _named(spark, d, model, keep):
    return three(spark, d).where(keep).select("vec_id", "truth", F.col(MODELS[model]).alias("predicted"))


@query(f"""SELECT vec_id, truth, predicted AS first_predicted, other AS second_predicted, third AS third_predicted, predicted = truth AS first_right, other = truth AS second_right, third = truth AS third_right, predicted = other AND other = third AS all_agree
  FROM ({THREE}) WHERE vec_id % 19 <> 3 AND vec_id % 17 <> 4""")
def three_model_pairing(spark, d):
    models = {m: _named(spark, d, m, k) for m, k in zip(MODELS, ("vec_id % 19 <> 3", "vec_id % 17 <> 4", "true"))}
    out = relate.paired(models, ["vec_id", "truth"], ["predicted"])
    right = {f"{m}_right": F.col(f"{m}_predicted") == F.col("truth") for m in MODELS}
    return out.withColumns(right).withColumn("all_agree", F.expr("first_predicted = second_predicted AND second_predicted = third_predicted"))


@query(f"""SELECT vec_id, CAST(vec_id % 19 <> 3 AS BIGINT) AS n_first, CAST(vec_id % 17 <> 4 AS BIGINT) AS n_second FROM ({PREDICTIONS}) WHERE (vec_id % 19 = 3) <> (vec_id % 17 = 4)""")
def unpaired_keys(spark, d):
    return relate.unpaired({"first": _named(spark, d, "first", "vec_id % 19 <> 3"), "second": _named(spark, d, "second", "vec_id % 17 <> 4")}, ["vec_id"])


_CHECKS = {
    "ids_unique": "count(DISTINCT vec_id) = count(*)",
    "ids_contiguous": "min(vec_id) = 0 AND max(vec_id) = count(*) - 1",
    "truth_in_range": "min(truth) >= 0 AND max(truth) <= 9",
    "predictions_in_range": "min(predicted) >= 0 AND max(predicted) <= 9 AND min(other) >= 0 AND max(other) <= 9",
    "scores_finite": "min(score) >= 0 AND max(score) <= 1",
    "all_classes_present": "count(DISTINCT truth) = 10",
    "no_zero_score": "min(score) > 0",
    "models_differ": "count(CASE WHEN predicted <> other THEN 1 END) > 0",
}


@query(" UNION ALL ".join(f"""SELECT '{k}' AS "check", {v} AS passed FROM ({PREDICTIONS})""" for k, v in _CHECKS.items()))
def named_checks(spark, d):
    return compare.checks(predictions(spark, d), {k: F.expr(v) for k, v in _CHECKS.items()})


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS k, {v} AS passed FROM ({PREDICTIONS})" for k, v in _CHECKS.items()) + """)
  SELECT CAST(count(*) AS BIGINT) AS checks, CAST(count(*) FILTER (WHERE NOT passed) AS BIGINT) AS failed, coalesce(string_agg(CASE WHEN NOT passed THEN k END, ';' ORDER BY k), '') AS names, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def check_gate(spark, d):
    return compare.gate(named_checks(spark, d))


_ONE = f"SELECT 0 AS class_id, score, y FROM ({_VERSUS})"
_MICRO = f"SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS called FROM (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM ({_VERSUS}) GROUP BY 1) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"
_AREAS = "sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS auroc, sum(pos * tp / called::DOUBLE) / sum(pos) AS ap"


@query(f"""SELECT round(avg(auroc), 6) AS macro_auroc, round(avg(ap), 6) AS macro_average_precision, round((SELECT auroc FROM (SELECT {_AREAS} FROM ({_MICRO}))), 6) AS micro_auroc, round((SELECT ap FROM (SELECT {_AREAS} FROM ({_MICRO}))), 6) AS micro_average_precision
  FROM (SELECT class_id, {_AREAS} FROM ({_STEPS}) GROUP BY 1)""")
def threshold_free_metrics(spark, d):
    out = metrics.threshold_free(_versus(spark, d), "score", "y", "class_id")
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query(f"""SELECT CAST(class_id AS INT) AS class_id, CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS tpr, 0.0::DOUBLE AS fpr FROM range(10) k(class_id)
  UNION ALL SELECT CAST(class_id AS INT), CAST(tp AS BIGINT), CAST(called - tp AS BIGINT), score, round(tp / (sum(pos) OVER p)::DOUBLE, 6), round((called - tp) / (sum(neg) OVER p)::DOUBLE, 6) FROM ({_STEPS}) WINDOW p AS (PARTITION BY class_id)""")
def roc_points(spark, d):
    return metrics.roc_points(_versus(spark, d), "score", "y", "class_id").withColumns({c: r6(c) for c in ("tpr", "fpr")})


@query(f"""WITH s AS (SELECT class_id, sum(CASE WHEN score >= 0.5 THEN y ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.5 THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN score < 0.5 THEN y ELSE 0 END) AS fn, sum(CASE WHEN score < 0.5 THEN 1 - y ELSE 0 END) AS tn FROM ({_VERSUS}) GROUP BY 1),
  a AS (SELECT class_id, {_AREAS} FROM ({_STEPS}) GROUP BY 1)
  SELECT CAST(class_id AS INT) AS class_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall,
  round(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision FROM s JOIN a USING (class_id)""")
def per_class_thresholded(spark, d):
    out = metrics.thresholded(_versus(spark, d), "score", "y", "class_id", 0.5)
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "auroc", "average_precision")})


_MULTI = f"SELECT k, CAST(k = truth OR k = other AS INT) AS t, CAST(k = predicted OR k = truth AS INT) AS p, vec_id FROM ({PREDICTIONS}) CROSS JOIN range(10) q(k)"


@query(f"""WITH m AS ({_MULTI}), c AS (SELECT k, sum(t * p) AS tp, sum(t) AS s, sum(p) AS q FROM m GROUP BY 1), f AS (SELECT s, CASE WHEN s + q = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (s + q) END AS f1 FROM c), r AS (SELECT vec_id, CASE WHEN sum(t + p) = 0 THEN 0.0 ELSE 2.0::DOUBLE * sum(t * p) / sum(t + p) END AS f1 FROM m GROUP BY 1)
  SELECT round((SELECT sum(f1 * s) / sum(s) FROM f), 6) AS weighted_f1, round((SELECT avg(f1) FROM r), 6) AS samples_f1""")
def multilabel_f1(spark, d):
    p = predictions(spark, d)
    out = metrics.multilabel_f1(p, cols.label_vector(F.array("truth", "other"), 10), cols.label_vector(F.array("predicted", "truth"), 10))
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query(f"""SELECT CAST(t.c AS INT) AS truth, CAST(p.c AS INT) AS predicted, round((count(x.vec_id) FILTER (WHERE x.other = p.c) - count(x.vec_id) FILTER (WHERE x.predicted = p.c)) / greatest(count(x.vec_id), 1)::DOUBLE, 6) AS difference
  FROM range(10) t(c) CROSS JOIN range(10) p(c) LEFT JOIN ({PREDICTIONS}) x ON x.truth = t.c GROUP BY 1, 2""")
def confusion_difference(spark, d):
    rows = predictions(spark, d)
    return metrics.normalised_difference(metrics.confusion(rows, 10), metrics.confusion(rows, 10, "truth", "other")).withColumn("difference", r6("difference"))


@query()
def bootstrap_metrics_ci(spark, d):
    """10,000 replicates of the sources of the documents that vectors stand for (a vector without a source is its own
    group): differences of four metrics of the three pairs of models, which share draws. A class that isn't the predicted
    one has an equal share of what the score leaves. Tested against rows that are really resampled."""
    source = table(spark, d, "documents").groupBy(F.col("doc_id").alias("vec_id")).agg(F.min("source").alias("source"))
    p = three(spark, d).join(source, "vec_id", "left").withColumn("cluster", F.coalesce(F.concat(F.lit("source "), "source"), F.concat(F.lit("vector "), F.col("vec_id").cast("string"))))
    score = lambda c: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == F.col(c), F.col("score")).otherwise((1 - F.col("score")) / 9))
    rows = p.select("cluster", "truth", *MODELS.values(), *(score(c).alias(f"{m}_scores") for m, c in MODELS.items()))
    found = resampling.replicate_metrics(rows, {m: (c, f"{m}_scores") for m, c in MODELS.items()}, 10, 10_000, 42)
    out = resampling.summary(resampling.paired_differences(found, _PAIRS), by=("pair", "metric"))
    return out.withColumns({c: r6(c) for c in ("mean", "se", "low", "high", "p_above", "p_below")})
