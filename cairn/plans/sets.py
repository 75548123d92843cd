"""Queries that audit whole sets and make reports of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import cols
from cairn.operators import audits, compare, history, integrity, reviews, samples, splits
from cairn.plans.audits import _assigned, _SOURCES
from cairn.plans.catalogue import _days, _DAYS, query, r6
from cairn.plans.models import _by_class, _classes, MODELS, THREE, three
from cairn.plans.reviews import _ERRORS, _REVIEWS, _view
from cairn.plans.tables import BOXES, PREDICTIONS, SPLIT_DOCS, boxes, predictions, split_docs, table

_NAMES = {0: "quality", 1: "toxic"}
_TOLD = """SELECT CAST(CASE WHEN doc_id % 50 = 7 THEN doc_id + 100000000 ELSE doc_id END AS VARCHAR) AS image_id, CAST(quality AS VARCHAR) AS class_id, CASE WHEN doc_id % 40 = 3 THEN 'toxic' WHEN quality = 1 THEN 'toxic' ELSE 'quality' END AS class_name FROM labels UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(quality AS VARCHAR), CASE WHEN quality = 1 THEN 'toxic' ELSE 'quality' END FROM labels WHERE toxic = 1"""


@query(f"""WITH t AS ({_TOLD}), v AS (SELECT *, class_name = CASE class_id WHEN '0' THEN 'quality' WHEN '1' THEN 'toxic' END AS ok FROM t), i AS (SELECT CAST(doc_id AS VARCHAR) AS id, count(*) AS c, min(CASE WHEN n_chars < 40 THEN 'short' ELSE '' END) AS error, min(sha256(text)) AS sha FROM documents GROUP BY 1), a AS (SELECT DISTINCT image_id FROM v WHERE ok), m AS (SELECT * FROM i FULL JOIN a ON id = image_id)
  SELECT unnest(['raw_image_count', 'annotation_rows', 'invalid_label_count', 'unique_annotation_image_id_count', 'manifest_rows', 'missing_image_count', 'image_without_annotation_count', 'unreadable_image_count', 'duplicate_image_id_count', 'duplicate_sha256_group_count', 'duplicate_annotation_row_count']) AS name,
  unnest([(SELECT count(*) FROM documents), (SELECT count(*) FROM t), (SELECT count(*) FROM v WHERE ok IS NOT TRUE), (SELECT count(*) FROM a), (SELECT count(*) FROM i WHERE error = ''), (SELECT count(*) FROM m WHERE id IS NULL), (SELECT count(*) FROM m WHERE image_id IS NULL), (SELECT count(*) FROM i WHERE error <> ''), (SELECT count(*) FROM i WHERE c > 1), (SELECT count(*) FROM (SELECT 1 FROM i WHERE error = '' AND sha IS NOT NULL GROUP BY sha HAVING count(*) > 1)), CAST((SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM t GROUP BY image_id, class_id, class_name)) AS BIGINT)]) AS value""")
def catalogue_audit(spark, d):
    """Documents as images (short ones can't be read) and labels as annotations, some of unknown documents or with a wrong name."""
    images = table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.sha2("text", 256).alias("sha256"), F.when(F.col("n_chars") < 40, "short").alias("error"))
    table(spark, d, "labels").createOrReplaceTempView("labels")
    return audits.catalogue(images, spark.sql(_TOLD.replace("AS VARCHAR", "AS STRING")), _NAMES)


_LANGS = ["de", "en", "es", "fr"]


@query(f"""WITH d AS (SELECT *, lang || '/' || coalesce(source, '') || '/' || n_chars AS path, CAST(n_chars AS VARCHAR) AS file_name FROM documents), s AS (SELECT DISTINCT source FROM documents WHERE n_chars > 3000),
  v AS (SELECT unnest(['total_count', 'unreadable_image_count', 'zero_byte_file_count', 'missing_class_id_count', 'invalid_class_id_count', 'missing_source_image_id_count', 'augmented_image_count', 'augmented_without_source_count', 'feature_index_min', 'feature_index_max', 'feature_index_distinct', {', '.join(f"'class_{c}_count'" for c in _LANGS)}]) AS name,
    unnest([count(*), count(*) FILTER (n_chars < 40), count(*) FILTER (n_chars = 0), count(*) FILTER (lang IS NULL), count(*) FILTER (lang NOT IN ('de', 'en', 'es', 'fr')), count(*) FILTER (trim(coalesce(source, '')) = ''), count(*) FILTER (n_chars > 5000), count(*) FILTER (n_chars > 5000 AND trim(coalesce(source, '')) = ''), min(doc_id), max(doc_id), count(DISTINCT doc_id), {', '.join(f"count(*) FILTER (lang = '{c}')" for c in _LANGS)}]) AS value FROM d
  UNION ALL SELECT 'source_image_id_not_in_metadata_count', count(*) FROM d WHERE trim(coalesce(source, '')) <> '' AND source NOT IN (SELECT source FROM s WHERE source IS NOT NULL)
  UNION ALL SELECT 'duplicate_path_count', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM d WHERE path IS NOT NULL GROUP BY path)
  UNION ALL SELECT 'duplicate_filename_within_class_count', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM d GROUP BY lang, file_name)
  UNION ALL SELECT 'duplicate_sha256_group_count', count(*) FROM (SELECT 1 FROM d WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate_sha256_image_count', CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM d WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1))
  SELECT name, CAST(value AS BIGINT) AS value FROM v UNION ALL SELECT 'status', CAST(count(*) FILTER (value <> 0 AND name IN ({', '.join(f"'{n}'" for n in audits.BALANCED_FAULTS)})) = 0 AND count(*) FILTER (name LIKE 'class\\_%\\_count' ESCAPE '\\' AND value <> 945) = 0 AS BIGINT) FROM v""")
def balanced_set_audit(spark, d):
    """Documents as images of a balanced set by language."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.concat("lang", F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("n_chars").cast("string")).alias("path"), F.col("n_chars").cast("string").alias("file_name"), F.col("lang").alias("class_id"), F.col("source").alias("source_image_id"), F.col("source").alias("original_roi_id"), (F.col("n_chars") > 5000).alias("augmented"), F.col("doc_id").alias("feature_index"), F.col("n_chars").alias("size"), F.when(F.col("n_chars") < 40, "short").alias("error"), F.sha2("text", 256).alias("sha256"))
    return audits.balanced_set(rows, docs.where("n_chars > 3000").select(F.col("source").alias("source_image_id")), _LANGS, 945)


_PINS = {"annotations": 60000, "images": 15000, "invalid_boxes": 0, "repeated_rows": 0, "class_A_rows": 20000, "class_Z_rows": 1}
_MEASURED = f"""SELECT unnest(['annotations', 'images', 'invalid_boxes']) AS name, unnest([count(*), count(DISTINCT l_orderkey), count(*) FILTER (NOT (x1 > x0 AND y1 > y0))]) AS value FROM ({BOXES}) UNION ALL SELECT 'repeated_rows', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM ({BOXES}) GROUP BY l_orderkey, l_linenumber, l_returnflag, x0, y0, x1, y1)
  UNION ALL SELECT 'class_' || l_returnflag || '_rows', count(*) FROM ({BOXES}) GROUP BY l_returnflag UNION ALL SELECT 'class_' || l_returnflag || '_images', count(DISTINCT l_orderkey) FROM ({BOXES}) GROUP BY l_returnflag"""


def _measured(spark, d):
    return audits.annotation_source(boxes(spark, d).drop("w", "h"), "l_orderkey", "l_returnflag", ("x0", "y0", "x1", "y1"))


@query(f"SELECT name, CAST(value AS BIGINT) AS value FROM ({_MEASURED})")
def annotation_source_audit(spark, d):
    return _measured(spark, d)


@query(f"SELECT p.name, CAST(p.expected AS BIGINT) AS expected, CAST(value AS BIGINT) AS value, coalesce(value = p.expected, false) AS passed FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {v})' for n, v in _PINS.items())}) p(name, expected) LEFT JOIN ({_MEASURED}) m ON m.name = p.name")
def pinned_totals(spark, d):
    """What the source of annotations should hold, beside what it holds."""
    return audits.pinned(_measured(spark, d), _PINS)


@query("""WITH m AS (SELECT doc_id AS i, count(*) AS a FROM documents GROUP BY 1), c AS (SELECT vec_id AS i, count(*) AS b FROM embeddings GROUP BY 1), j AS (SELECT coalesce(m.i, c.i) AS i, a, b FROM m FULL JOIN c ON m.i = c.i),
  v AS (SELECT unnest(['only_manifest', 'only_cache', 'repeated_manifest', 'repeated_cache', 'gaps', 'foreign']) AS k, unnest([count(*) FILTER (b IS NULL), count(*) FILTER (a IS NULL), CAST(coalesce(sum(a - 1), 0) AS BIGINT), CAST(coalesce(sum(b - 1), 0) AS BIGINT), max(i) + 1 - count(*) FILTER (a IS NOT NULL), (SELECT count(*) FROM embeddings WHERE label IS DISTINCT FROM 3)]) AS n FROM j)
  SELECT k AS "check", n = 0 AS passed, CAST(n AS BIGINT) AS n FROM v""")
def manifest_and_cache(spark, d):
    """Documents as a manifest beside vectors as its cache."""
    cache = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("string").alias("revision"))
    return audits.against_cache(table(spark, d, "documents").select(F.col("doc_id").alias("i")), cache, "i", ("revision", "3"))


_CONDITIONS = {"rows_500": "count(*) = 500", "ids_unique": "count(DISTINCT vec_id) = count(*)", "predictions_in_range": "min({p}) >= 0 AND max({p}) <= 9", "half_right": "2 * sum(CASE WHEN {p} = truth THEN 1 ELSE 0 END) >= count(*)", "three_quarters_right": "4 * sum(CASE WHEN {p} = truth THEN 1 ELSE 0 END) >= 3 * count(*)"}


@query("WITH c AS (" + " UNION ALL ".join(f"""SELECT '{m}' AS model, '{k}' AS k, {v.format(p=p)} AS passed FROM ({THREE})""" for m, p in MODELS.items() for k, v in _CONDITIONS.items()) + """) SELECT k AS "check", bool_and(passed) AS passed, coalesce(string_agg(model, ';' ORDER BY model) FILTER (NOT passed), '') AS failing FROM c GROUP BY 1""")
def input_integrity(spark, d):
    """Checks that all models must pass, with those that don't."""
    rows = three(spark, d)
    each = [compare.checks(rows, {k: F.expr(v.format(p=p)) for k, v in _CONDITIONS.items()}).select(F.lit(m).alias("model"), "check", "passed") for m, p in MODELS.items()]
    return audits.conjunction(audits.stacked(each))


_WIDE = {m: f"SELECT CAST(class_id AS INT) AS class_id, unnest(['f1', 'recall']) AS metric, unnest([f1, recall]) AS value FROM ({_by_class(m)})" for m in MODELS}


@query(f"""SELECT class_id, metric, round(a.value, 6) AS first, round(b.value, 6) AS second, round(c.value, 6) AS third, round(b.value - a.value, 6) AS second_minus_first, round(c.value - a.value, 6) AS third_minus_first, round(c.value - b.value, 6) AS third_minus_second, class_id IN (2, 3, 4) AS highlighted
  FROM ({_WIDE['first']}) a JOIN ({_WIDE['second']}) b USING (class_id, metric) JOIN ({_WIDE['third']}) c USING (class_id, metric)""")
def per_class_wide(spark, d):
    each = [compare.long_metrics(_classes(spark, d, m).select("class_id", "f1", "recall"), ["class_id"]).withColumn("model", F.lit(m)) for m in MODELS]
    out = audits.wide_models(audits.stacked(each), list(MODELS), [2, 3, 4])
    return out.withColumns({c: r6(c) for c in out.columns if c not in ("class_id", "metric", "highlighted")})


@query(f"""{_ERRORS} SELECT 'status' AS kind, lower(trim(review_status)) AS name, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 2 UNION ALL SELECT 'error', error, CAST(count(*) AS BIGINT) FROM e GROUP BY 2""")
def review_report(spark, d):
    rows = _view(spark, d, _REVIEWS)
    return audits.status_report(rows, "review_status", reviews.review_errors(rows, "row"), "error")


@query(f"""WITH m AS (SELECT name, value FROM ({_MEASURED})), l AS (SELECT 'languages' AS name, count(DISTINCT lang) AS value FROM documents UNION ALL SELECT 'documents', count(*) FROM documents)
  SELECT '{{"annotations":{{' || (SELECT string_agg('"' || name || '":' || value, ',' ORDER BY name) FROM m) || '}},"texts":{{' || (SELECT string_agg('"' || name || '":' || value, ',' ORDER BY name) FROM l) || '}}}}' AS record""")
def final_record(spark, d):
    texts = audits.measures(table(spark, d, "documents"), {"documents": F.count("*"), "languages": F.count_distinct("lang")})
    return audits.record({"annotations": _measured(spark, d), "texts": texts})


@query("SELECT lang, source, CAST(count(DISTINCT doc_id) AS BIGINT) AS available, CAST(20 AS BIGINT) AS requested, CAST(least(count(DISTINCT doc_id), 20) AS BIGINT) AS rendered FROM documents GROUP BY 1, 2")
def overlay_availability(spark, d):
    return audits.availability(table(spark, d, "documents"), ["lang", "source"], "doc_id", 20)


@query(f"""SELECT vec_id, concat_ws('|', CASE WHEN score >= 0.5 THEN '0' END, CASE WHEN 1 - score >= 0.3::DOUBLE THEN '1' END, CASE WHEN score / 2 >= 0.4::DOUBLE THEN '2' END) AS positive_ids, concat_ws('|', CASE WHEN score >= 0.5 THEN 'low' END, CASE WHEN 1 - score >= 0.3::DOUBLE THEN 'mid' END, CASE WHEN score / 2 >= 0.4::DOUBLE THEN 'high' END) AS positive_names,
  CAST(score >= 0.5 AS BIGINT) + CAST(1 - score >= 0.3::DOUBLE AS BIGINT) + CAST(score / 2 >= 0.4::DOUBLE AS BIGINT) AS n_positive, CAST(CASE WHEN score >= 1 - score THEN 0 ELSE 1 END AS INT) AS top_id, CASE WHEN score >= 1 - score THEN 'low' ELSE 'mid' END AS top_name FROM ({PREDICTIONS})""")
def inference_rows(spark, d):
    s = F.col("score")
    return audits.inference_rows(predictions(spark, d).select("vec_id", F.array(s, 1 - s, s / 2).alias("p")), "p", [0.5, 0.3, 0.4], ["low", "mid", "high"])


_TOP = "CASE WHEN vec_id % 17 = 3 THEN (predicted + 1) % 10 ELSE predicted END"


def _predicted(spark, d):
    """Predictions with nine tenths of the probability on one class, some of them with a fault."""
    p = predictions(spark, d)
    top = F.expr(_TOP)
    arrays = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == top, F.lit(0.91)).otherwise(F.when(F.col("vec_id") % 29 == 4, F.lit(0.02)).otherwise(F.lit(0.01))))
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    return p.select("vec_id", F.col("truth").alias("true_class_id"), name("truth").alias("true_class_name"), F.when(F.col("vec_id") % 31 == 5, 12).otherwise(F.col("predicted")).alias("predicted_class_id"), F.when(F.col("vec_id") % 37 == 6, "?").otherwise(name("predicted")).alias("predicted_class_name"), arrays.alias("probabilities"), F.when(F.col("vec_id") % 41 == 7, F.lit(0.5)).otherwise(F.lit(0.91)).alias("confidence"), (F.col("truth") == F.col("predicted")).alias("is_correct"))


_FAULTS = {"invalid_class": "vec_id % 31 = 5", "class_name_mismatch": "vec_id % 37 = 6 AND vec_id % 31 <> 5", "bad_sum": "vec_id % 29 = 4", "not_the_top": "vec_id % 29 <> 4 AND top <> called", "confidence_mismatch": "vec_id % 29 <> 4 AND vec_id % 41 = 7", "correctness_mismatch": "(truth = predicted) <> (truth = called)"}


@query(f"WITH p AS (SELECT *, {_TOP} AS top, CASE WHEN vec_id % 31 = 5 THEN 12 ELSE predicted END AS called FROM ({PREDICTIONS})) " + " UNION ALL ".join(f"SELECT vec_id, '{n}' AS error FROM p WHERE {c}" for n, c in _FAULTS.items()))
def prediction_errors(spark, d):
    return integrity.prediction_errors(_predicted(spark, d), "vec_id", {k: f"c{k}" for k in range(10)})


_PARTS = {"train": 800, "val": 100, "test": 100}
_PAIRS_OF = [("train", "val"), ("train", "test"), ("val", "test")]


@query(f"""WITH d AS ({SPLIT_DOCS}), v AS (SELECT 'master_rows' AS k, count(*) = 1000 AS ok, count(*) AS n FROM d UNION ALL SELECT 'unknown_split', count(*) FILTER (split NOT IN ('train', 'val', 'test')) = 0, count(*) FILTER (split NOT IN ('train', 'val', 'test')) FROM d
  UNION ALL """ + " UNION ALL ".join(f"SELECT '{s}_rows', count(*) FILTER (split = '{s}') = {n}, count(*) FILTER (split = '{s}') FROM d" for s, n in _PARTS.items()) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{s}_long_{g}', count(*) FILTER (split = '{s}' AND {c}) > 0, count(*) FILTER (split = '{s}' AND {c}) FROM d" for s in _PARTS for g, c in (("positive", "n_chars > 3000"), ("negative", "n_chars <= 3000")))
  + " UNION ALL " + " UNION ALL ".join(f"SELECT 'duplicate_{f}', count({f}) = count(DISTINCT {f}), count({f}) - count(DISTINCT {f}) FROM d" for f in ("doc_id", "sha")) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{a}_{b}_{f}', count(*) = 0, count(*) FROM (SELECT {f} FROM d WHERE split = '{a}' AND {f} IS NOT NULL INTERSECT SELECT {f} FROM d WHERE split = '{b}')" for f in ("sha", "source") for a, b in _PAIRS_OF) + """) SELECT k AS "check", ok AS passed, CAST(n AS BIGINT) AS n FROM v""")
def split_integrity(spark, d):
    """Sizes, repeats, values that splits share and presence of a class, for documents split by a hash."""
    return integrity.split_integrity(split_docs(spark, d), _PARTS, ["doc_id", "sha"], ["sha", "source"], {"long": F.col("n_chars") > 3000})


@query("""SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'toxic ' || toxic END, '') AS manual_crop_review_status, coalesce('label ' || e.label, 'not_sampled') AS manual_output_review_status, coalesce(quality = 1, false) AS include_for_model, CASE WHEN quality IS DISTINCT FROM 1 THEN 'missing_from_final' WHEN n_chars < 40 THEN 'conversion_not_success' ELSE '' END AS error
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def master_rows(spark, d):
    """Documents as a manifest, labels as what is final, vectors as reviews of outputs."""
    manifest = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("source_crop_path"), F.col("doc_id").alias("output_path"), F.when(F.col("n_chars") < 40, "short").otherwise("success").alias("conversion_status"))
    final = table(spark, d, "labels").select(F.col("doc_id").alias("source_crop_path"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("manual_review_status"), (F.col("quality") == 1).alias("include"))
    manual = table(spark, d, "embeddings").select(F.col("vec_id").alias("output_path"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("review_status"))
    return integrity.master(manifest, final, manual).select("doc_id", "manual_crop_review_status", "manual_output_review_status", "include_for_model", "error")


@query(f"""SELECT d.source, split, CAST(max(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) AS INT) AS lang_de_present, CAST(max(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS INT) AS lang_en_present, CAST(max(CASE WHEN lang = 'es' THEN 1 ELSE 0 END) AS INT) AS lang_es_present, CAST(max(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) AS INT) AS lang_fr_present, 42 AS random_seed
  FROM documents d LEFT JOIN ({_SOURCES}) a ON a.source = d.source WHERE d.source IS NOT NULL GROUP BY 1, 2""")
def source_manifest(spark, d):
    return splits.source_manifest(table(spark, d, "documents"), _assigned(spark, d), "source", "lang", _LANGS, 42)


@query("SELECT event_type, epoch, v FROM (" + _DAYS + ") JOIN (SELECT event_type, max(epoch) - 5 AS start FROM (" + _DAYS + ") GROUP BY 1) USING (event_type) WHERE epoch < start")
def resumed_steps(spark, d):
    """Histories cut before the step at which a training resumes, five steps before their end."""
    days = _days(spark, d)
    return history.resumed(days, days.groupBy("event_type").agg((F.max("epoch") - 5).alias("start")), ["event_type"], "epoch")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars BETWEEN 200 AND 400 ORDER BY doc_id LIMIT 1")
def first_readable(spark, d):
    return samples.first_where(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), F.col("n_chars").between(200, 400), ["doc_id"])


@query(r"SELECT doc_id, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 57)) || '...' ELSE t END AS excerpt, lower(upper(lang)) AS folded FROM (SELECT doc_id, lang, trim(regexp_replace(text, '[ \t\n\r\v\f]+', ' ', 'g')) AS t FROM documents)")
def excerpts(spark, d):
    """Texts on one line, cut to sixty characters."""
    return table(spark, d, "documents").select("doc_id", cols.collapsed(F.col("text"), 60).alias("excerpt"), cols.folded(F.col("lang")).alias("folded"))


_RULED = {"index_null": "count(*) FILTER (doc_id IS NULL)", "blank_lang": "count(*) FILTER (trim(coalesce(lang, '')) = '')", "blank_source": "count(*) FILTER (trim(coalesce(source, '')) = '')", "index_repeated": "count(doc_id) - count(DISTINCT doc_id)", "index_gaps": "max(doc_id) + 1 - count(DISTINCT doc_id)", "duplicate_n_chars": "count(n_chars) - count(DISTINCT n_chars)", "other_classes": "count(*) FILTER (coalesce(lang, '') NOT IN ('de', 'en', 'es'))"}


@query(" UNION ALL ".join(f"""SELECT '{k}' AS "check", {v} = 0 AS passed, CAST({v} AS BIGINT) AS n FROM documents""" for k, v in _RULED.items()) + " UNION ALL " + " UNION ALL ".join(f"SELECT 'class_{k}_rows', count(*) FILTER (lang = '{k}') = {n}, count(*) FILTER (lang = '{k}') FROM documents" for k, n in (("de", 129), ("en", 600), ("es", 100))))
def manifest_checks(spark, d):
    """Documents as a manifest with numbered rows; one of its languages isn't expected."""
    return integrity.manifest_checks(table(spark, d, "documents"), "doc_id", ["lang", "source"], ["n_chars"], {"de": 129, "en": 600, "es": 100}, "lang")


@query(f"""WITH d AS ({SPLIT_DOCS}), c AS (SELECT split, coalesce(lang, '') AS k, count(*) AS n FROM d GROUP BY 1, 2), s AS (SELECT DISTINCT split, source FROM d WHERE source IS NOT NULL), m AS (SELECT source, count(*) > 1 AS several FROM s GROUP BY 1)
  SELECT c.split, CAST(sum(n) AS BIGINT) AS rows, (SELECT count(*) FROM s WHERE s.split = c.split) AS sources, string_agg(k || '=' || n, ';' ORDER BY k) AS classes, (SELECT count(*) FROM s JOIN m USING (source) WHERE s.split = c.split AND several) AS shared FROM c GROUP BY 1""")
def split_report(spark, d):
    out = splits.report(split_docs(spark, d), "source", "lang")
    return out.withColumn("classes", F.array_join(F.transform(F.array_sort(F.map_entries("classes")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";"))


@query(f"""WITH p AS (SELECT doc_id, row_number() OVER (PARTITION BY split ORDER BY sha256('42:' || doc_id), doc_id) AS pick FROM ({SPLIT_DOCS})) SELECT lang, n_chars > 3000 AS long, CAST(count(*) AS BIGINT) AS n, CAST(count(pick) AS BIGINT) AS shown, CAST(min(pick) AS INT) AS first_pick FROM documents LEFT JOIN (SELECT * FROM p WHERE pick <= 9) USING (doc_id) GROUP BY 1, 2""")
def gallery_groups(spark, d):
    """Documents by language and length, with how many of each kind a sample of nine a split shows."""
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") > 3000).alias("long"))
    return samples.gallery(docs, samples.stratified(split_docs(spark, d), ["split"], "doc_id", 9), ["lang", "long"], "doc_id")


_RUNS = "SELECT event_type, count(*) AS steps, sum(epoch % 5 + 1) AS seconds, max(epoch % 9) AS memory, avg(1.0::DOUBLE / (epoch % 5 + 1)) AS rate, max(v) AS best_score FROM (" + _DAYS + ") GROUP BY 1"
_LONG = "SELECT unnest(['steps', 'seconds', 'memory', 'rate', 'best_score']) AS metric, unnest([steps::DOUBLE, seconds::DOUBLE, memory::DOUBLE, rate, best_score]) AS value FROM (" + _RUNS + ") WHERE event_type = '{}'"


@query(f"""SELECT metric, round(a.value, 6) AS first, round(b.value, 6) AS second, round(b.value - a.value, 6) AS difference, round(100 * (b.value - a.value) / nullif(a.value, 0), 6) AS relative_percent, CASE WHEN abs(b.value - a.value) <= 1e-12 THEN 'tie' WHEN (b.value > a.value) = (metric IN ('rate', 'best_score')) THEN 'second' ELSE 'first' END AS better
  FROM ({_LONG.format('click')}) a JOIN ({_LONG.format('view')}) b USING (metric)""")
def efficiency_comparison(spark, d):
    """Two trainings side by side: fewer steps, seconds and memory are better."""
    runs = _days(spark, d).withColumns({"seconds": F.col("epoch") % 5 + 1, "memory": F.col("epoch") % 9})
    each = history.efficiency(runs, ["event_type"], "epoch", "v", "seconds", "memory").drop("best_step")
    one = lambda kind: compare.long_metrics(each.where(F.col("event_type") == kind).drop("event_type"))
    out = compare.versus(one("click"), one("view"), [], ("first", "second"), ("steps", "seconds", "memory"))
    return out.select("metric", *(r6(c).alias(c) for c in ("first", "second", "difference", "relative_percent")), "better")
