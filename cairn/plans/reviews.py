"""Queries that audit annotations, validate reviews, and show members of groups instead of lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import annotations, relate, reviews
from cairn.plans.catalogue import _REASON, query
from cairn.plans.tables import PREDICTIONS, SPLIT_DOCS, boxes, predictions, split_docs, table

_CLASS = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
_SPLIT = "CASE WHEN l_orderkey % 10 < 8 THEN 'train' WHEN l_orderkey % 10 = 8 THEN 'val' ELSE 'test' END"
_AUDITED = f"""SELECT a.l_orderkey, a.l_linenumber, {_CLASS} AS class_id, {_SPLIT} AS split, CASE WHEN row_number() OVER (PARTITION BY a.l_orderkey, {_CLASS} ORDER BY l_linenumber, a.x0, a.y0, a.x1, a.y1) > 1 THEN 'duplicate_annotation' WHEN o_orderkey IS NULL THEN 'missing_image' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'image_read_error' ELSE a.reason END AS reason,
  a.x0 < 0 OR a.y0 < 0 OR a.x1 > a.w OR a.y1 > a.h AS clamp FROM ({_REASON}) a LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = a.l_orderkey"""


def _audited(spark, d):
    """Order lines as boxes in images, which are orders: those in progress are missing, those without a priority can't be read."""
    rows = boxes(spark, d).withColumns({"class_id": F.expr(_CLASS), "split": F.expr(_SPLIT), "row": F.struct("l_linenumber", "x0", "y0", "x1", "y1")})
    images = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(100).alias("width"), F.lit(80).alias("height"), F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "truncated").alias("error"))
    return annotations.audit(rows, images, ["l_orderkey", "class_id"], "l_orderkey", "row")


@query(f"SELECT l_orderkey, l_linenumber, reason, clamp AND reason NOT IN ('duplicate_annotation', 'missing_image', 'image_read_error') AS needs_clamp FROM ({_AUDITED})")
def annotation_audit(spark, d):
    return _audited(spark, d).select("l_orderkey", "l_linenumber", "reason", "needs_clamp")


_TALLIES = "CAST(count(x.l_orderkey) AS BIGINT) AS annotations, CAST(count(*) FILTER (x.reason = '') AS BIGINT) AS valid, CAST(count(*) FILTER (x.reason = 'duplicate_annotation') AS BIGINT) AS duplicate, CAST(count(*) FILTER (x.reason = 'missing_image') AS BIGINT) AS missing, CAST(count(*) FILTER (x.reason NOT IN ('', 'duplicate_annotation', 'missing_image')) AS BIGINT) AS invalid"


@query(f"""SELECT s.split, CAST(k.class_id AS INT) AS class_id, {_TALLIES}, CAST(count(DISTINCT x.l_orderkey) FILTER (x.reason = '') AS BIGINT) AS images FROM (VALUES ('train'), ('val'), ('test')) s(split) CROSS JOIN range(4) k(class_id) LEFT JOIN ({_AUDITED}) x ON x.split = s.split AND x.class_id = k.class_id GROUP BY 1, 2""")
def annotation_class_counts(spark, d):
    """By split and class, of which the last has no rows."""
    return annotations.class_counts(_audited(spark, d), "l_orderkey", ["train", "val", "test"], [0, 1, 2, 3])


@query(f"""SELECT l_orderkey, {_TALLIES}, coalesce(string_agg(DISTINCT CASE WHEN x.reason = '' THEN class_id END, ';' ORDER BY CASE WHEN x.reason = '' THEN class_id END), '') AS classes, CAST(count(DISTINCT CASE WHEN x.reason = '' THEN class_id END) AS BIGINT) AS n_classes, count(DISTINCT CASE WHEN x.reason = '' THEN class_id END) = 1 AS single FROM ({_AUDITED}) x GROUP BY 1""")
def annotation_images(spark, d):
    out = annotations.image_counts(_audited(spark, d), "l_orderkey")
    return out.withColumn("classes", F.array_join(F.transform("classes", lambda c: c.cast("string")), ";"))


@query(f"SELECT CASE WHEN reason = '' THEN 'valid' WHEN reason = 'duplicate_annotation' THEN 'duplicate' WHEN reason = 'missing_image' THEN 'missing' WHEN reason = 'image_read_error' THEN 'unreadable' ELSE 'invalid' END AS route, CAST(count(*) AS BIGINT) AS n FROM ({_AUDITED}) GROUP BY 1 UNION ALL SELECT 'clamped', CAST(count(*) AS BIGINT) FROM ({_AUDITED}) WHERE reason = '' AND clamp")
def annotation_routes(spark, d):
    """How many rows go to each of the six outputs."""
    out = None
    for name, rows in annotations.routed(_audited(spark, d)).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("route"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0 OR route = 'clamped'")


#: Turns as reviews of crops: some name another crop than their number, some repeat an annotation, some have a blank name or a strange status.
_REVIEWS = """SELECT conv_id * 1000 + turn AS "row", conv_id || '_bbox' || CASE WHEN length(text) % 7 = 0 THEN turn + 1 ELSE turn END || CASE WHEN length(text) % 13 = 0 THEN '.jpg' ELSE '.png' END AS crop_path, CAST(conv_id AS VARCHAR) AS source_image_id, 'train' AS split, CAST(turn % 3 AS VARCHAR) AS class_id,
  CASE WHEN length(text) % 5 = 0 THEN ' ' ELSE 'c' || turn % 3 END AS class_name, CASE WHEN length(text) % 17 = 0 THEN 'x' ELSE CAST(CASE WHEN length(text) % 11 = 0 THEN turn + 3 ELSE turn END AS VARCHAR) END AS annotation_index, CASE role WHEN 'user' THEN ' PASS' WHEN 'assistant' THEN 'fail' ELSE 'odd' END AS review_status, 'none' AS technical_issue, '' AS review_note FROM conversations"""
_MANIFEST = """SELECT conv_id || '_bbox' || turn || '.png' AS crop_path, CAST(conv_id AS VARCHAR) AS source_image_id, 'train' AS split, CAST(turn % 3 AS VARCHAR) AS class_id, 'c' || turn % 3 AS class_name, CAST(turn AS VARCHAR) AS annotation_index FROM conversations"""


def _view(spark, d, sql):
    table(spark, d, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(sql.replace('"row"', "`row`").replace("AS VARCHAR", "AS STRING"))


_NAMED = "CASE WHEN crop_path LIKE '%.png' THEN CAST(regexp_extract(crop_path, '_bbox(\\d+)', 1) AS BIGINT) END"
_ERRORS = f"""WITH r AS (SELECT *, {_NAMED} AS named, TRY_CAST(annotation_index AS BIGINT) AS told FROM ({_REVIEWS})),
  e AS (SELECT "row", 'missing_class_name' AS error, 'class_name is blank' AS detail FROM r WHERE trim(class_name) = ''
  UNION ALL SELECT "row", 'invalid_review_status', review_status FROM r WHERE review_status = 'odd'
  UNION ALL SELECT "row", CASE WHEN named IS NULL THEN 'missing_bbox_index_in_filename' WHEN told IS NULL THEN 'invalid_annotation_index' ELSE 'annotation_index_filename_mismatch' END, CASE WHEN named IS NULL THEN crop_path WHEN told IS NULL THEN annotation_index ELSE told || ' and ' || named END FROM r WHERE named IS NULL OR told IS NULL OR told <> named
  UNION ALL SELECT "row", 'duplicate_crop_path', 'one of ' || n FROM (SELECT *, count(*) OVER (PARTITION BY crop_path) AS n FROM r) WHERE n > 1
  UNION ALL SELECT "row", 'duplicate_annotation_index', 'one of ' || n FROM (SELECT r."row", k.n FROM r JOIN (SELECT source_image_id, class_id, annotation_index, count(*) AS n FROM r GROUP BY ALL HAVING count(DISTINCT crop_path) > 1) k USING (source_image_id, class_id, annotation_index)))"""


@query(f'{_ERRORS} SELECT "row", error, detail FROM e')
def review_errors(spark, d):
    """What each review has wrong, by itself and beside others."""
    return reviews.review_errors(_view(spark, d, _REVIEWS), "row")


@query(f"""{_ERRORS}, k AS (SELECT error, count(*) AS n FROM e GROUP BY 1) SELECT CAST((SELECT count(*) FROM r) AS BIGINT) AS rows, CAST((SELECT count(DISTINCT "row") FROM e) AS BIGINT) AS rows_with_errors, CAST((SELECT sum(n) FROM k) AS BIGINT) AS errors, (SELECT string_agg(error || '=' || n, ';' ORDER BY error) FROM k) AS kinds, CASE WHEN (SELECT count(*) FROM e) = 0 THEN 'PASS' ELSE 'FAIL' END AS status""")
def review_summary(spark, d):
    rows = _view(spark, d, _REVIEWS)
    out = reviews.summary(rows, reviews.review_errors(rows, "row"))
    text = F.transform(F.array_sort(F.map_entries("kinds")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return out.withColumn("kinds", F.array_join(text, ";"))


@query(f"""WITH r AS (SELECT *, {_NAMED} AS named, TRY_CAST(annotation_index AS BIGINT) AS told FROM ({_REVIEWS})), j AS (SELECT r.*, m.crop_path IS NOT NULL AS there, concat_ws(';', CASE WHEN r.class_id <> m.class_id THEN 'class_id' END, CASE WHEN trim(r.class_name) <> m.class_name THEN 'class_name' END, CASE WHEN r.annotation_index <> m.annotation_index THEN 'annotation_index' END) AS differ FROM r LEFT JOIN ({_MANIFEST}) m ON m.crop_path = r.crop_path)
  SELECT "row", CASE WHEN there THEN 'manifest_field_mismatch' ELSE 'crop_path_missing_from_manifest' END AS error, CASE WHEN there THEN differ ELSE crop_path END AS detail FROM j WHERE NOT there OR differ <> ''
  UNION ALL SELECT "row", 'annotation_index_filename_mismatch', concat_ws(' and ', told, named) FROM j WHERE there AND (named IS NULL OR told IS NULL OR told <> named)""")
def repaired_review_errors(spark, d):
    return reviews.against_manifest(_view(spark, d, _REVIEWS), _view(spark, d, _MANIFEST), "row")


@query(f"""SELECT m.crop_path, m.class_id, coalesce(r.s, 'not_sampled') AS manual_review_status, coalesce(r.i, '') AS technical_issue, coalesce(r.s, '') <> 'fail' AS include_for_model, CASE WHEN r.s = 'fail' THEN 'manual_review_fail' ELSE '' END AS exclusion_reason
  FROM ({_MANIFEST}) m LEFT JOIN (SELECT crop_path, arg_max(lower(trim(review_status)), "row") AS s, arg_max(technical_issue, "row") AS i FROM ({_REVIEWS}) GROUP BY 1) r ON r.crop_path = m.crop_path""")
def crops_with_reviews(spark, d):
    out = reviews.with_reviews(_view(spark, d, _MANIFEST), _view(spark, d, _REVIEWS))
    return out.select("crop_path", "class_id", "manual_review_status", "technical_issue", "include_for_model", "exclusion_reason")


@query("""WITH k AS (SELECT l_orderkey, l_partkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey, l_partkey, sum(c) AS n, count(*) AS v FROM k GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, CAST(v AS BIGINT) AS "values", CAST(n - c AS BIGINT) AS others FROM lineitem JOIN k USING (l_orderkey, l_partkey, l_returnflag) JOIN t USING (l_orderkey, l_partkey)""")
def conflict_members(spark, d):
    """Lines of an order and part with several flags: as many rows as lines, where `same_key_conflicts` has pairs."""
    return relate.conflict_members(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_partkey"], ["l_returnflag"])


@query(f"""SELECT doc_id, sha, split, source, CAST(copies AS BIGINT) AS copies, CAST(parts AS BIGINT) AS parts, CAST(sources AS BIGINT) AS sources, parts > 1 AS crosses_parts, sources > 1 AS crosses_sources
  FROM ({SPLIT_DOCS}) JOIN (SELECT sha, count(*) AS copies, count(DISTINCT split) AS parts, count(DISTINCT source) AS sources FROM ({SPLIT_DOCS}) WHERE sha IS NOT NULL GROUP BY 1 HAVING count(*) > 1) USING (sha)""")
def sha_members(spark, d):
    return relate.content_members(split_docs(spark, d).select("doc_id", "sha", "split", "source"), "sha", "split", "source")


_PARTS = ["documents", "benchmark", "conversations"]
_UNITED = "SELECT 'documents' AS part, sha256(text) AS sha, 'd/' || doc_id AS path, source FROM documents UNION ALL SELECT 'benchmark', sha256(text), 'b/' || item_id, 'benchmark' FROM benchmark UNION ALL SELECT 'conversations', sha256(text), 'c/' || conv_id, role FROM conversations"


@query(f"""WITH u AS ({_UNITED}) SELECT sha, CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT path) AS BIGINT) AS paths, {', '.join(f"CAST(count(*) FILTER (part = '{p}') AS BIGINT) AS {p}_records" for p in _PARTS)}, CAST(count(DISTINCT source) AS BIGINT) AS sources, coalesce(string_agg(DISTINCT source, ';' ORDER BY source), '') AS source_ids, count(DISTINCT source) > 1 AS is_cross_source
  FROM u WHERE sha IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def cross_set_groups(spark, d):
    one = lambda name, path, source: table(spark, d, name).select(F.lit(name).alias("part"), F.sha2("text", 256).alias("sha"), path.alias("path"), source.alias("source"))
    at = lambda letter, c: F.concat(F.lit(f"{letter}/"), F.col(c).cast("string"))
    rows = one("documents", at("d", "doc_id"), F.col("source")).unionByName(one("benchmark", at("b", "item_id"), F.lit("benchmark"))).unionByName(one("conversations", at("c", "conv_id"), F.col("role")))
    return relate.content_groups(rows, "sha", "part", _PARTS, "path", "source")


@query(f"SELECT vec_id, truth, predicted, other FROM ({PREDICTIONS}) WHERE predicted IS DISTINCT FROM other")
def discordant_predictions(spark, d):
    return relate.discordant(predictions(spark, d).select("vec_id", "truth", "predicted", "other"), "predicted", "other")


@query(f"""WITH r AS (SELECT *, min(doc_id) OVER (PARTITION BY sha) AS original FROM ({SPLIT_DOCS}) WHERE sha IS NOT NULL) SELECT original, CAST(count(*) FILTER (split = 'train' AND doc_id <> original) AS BIGINT) AS augmented_rows, CAST(count(*) FILTER (split <> 'train') AS BIGINT) AS held_out_rows FROM r GROUP BY 1 HAVING count(*) FILTER (split = 'train' AND doc_id <> original) > 0 AND count(*) FILTER (split <> 'train') > 0""")
def augmentation_leak(spark, d):
    """Copies of a document stand for augmented ones; their original is the first document of the same text."""
    docs = split_docs(spark, d).where("sha IS NOT NULL")
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("original"))
    rows = docs.join(first, "sha").withColumn("augmented", F.col("doc_id") != F.col("original"))
    return relate.augmentation_leak(rows, "original", "augmented")
