"""Queries about documents of settings, alignment by position, counters, digests and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import configs, counters, digests, moments
from cairn.plans.audits import _shifted, _SHIFTED
from cairn.plans.catalogue import query
from cairn.plans.tables import SPLIT_DOCS, split_docs, table

#: Path and value of a settings document, as the query below builds it from an event.
_PATHS = {"$.limits[0]": "CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)", "$.limits[1]": "CAST(user_id % 5 AS VARCHAR)", "$.run.k": "json_extract_string(props, '$.k')", "$.run['the type']": "'\"' || event_type || '\"'"}


def _settings(spark, d, pick):
    """The first or the last event of each user, as a nested document."""
    text = F.format_string('{"run": {"the type": "%s", "k": %s}, "limits": [%d, %d], "tags": []}', "event_type", F.get_json_object("props", "$.k"), F.floor("value"), F.col("user_id") % 5)
    return table(spark, d, "events").withColumn("doc", text).groupBy("user_id").agg(pick("doc", "event_id").alias("doc"))


def _both(change: str) -> str:
    rows = " UNION ALL ".join(f"SELECT user_id, event_id, $${p}$$ AS path, {v} AS value FROM events" for p, v in _PATHS.items())
    return f"""SELECT user_id, path, arg_min(value, event_id) AS first, arg_max(value, event_id) AS second FROM ({rows}) GROUP BY 1, 2 HAVING {change}"""


_DIFFER = "arg_min(value, event_id) <> arg_max(value, event_id)"


@query(f"SELECT user_id, path, first, second, 'changed' AS change FROM ({_both(_DIFFER)})")
def config_differences(spark, d):
    """Settings of each user's first and last event, compared path by path."""
    return configs.differences(_settings(spark, d, F.min_by), _settings(spark, d, F.max_by), ["user_id"], "doc")


@query(f"SELECT u.user_id, count(x.path) = 0 AS equal, CAST(count(x.path) AS BIGINT) AS different FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN ({_both(_DIFFER)}) x ON x.user_id = u.user_id GROUP BY 1")
def config_equality(spark, d):
    return configs.equal_configs(_settings(spark, d, F.min_by), _settings(spark, d, F.max_by), ["user_id"], "doc")


_PATCHES = f"SELECT vec_id, label, CAST(q AS INT) AS position, list_transform(list_slice(a, q * 8 + 1, q * 8 + 8), lambda x: x::DOUBLE) AS x, list_slice(b, q * 8 + 1, q * 8 + 8) AS y FROM ({_SHIFTED}) CROSS JOIN range(8) r(q)"
_PAIRED = f"SELECT vec_id, label, position, list_sum(list_transform(list_zip(x, y), lambda z: pow(z[1] - z[2], 2))) / 8 AS mse, list_cosine_similarity(x, y) AS cosine FROM ({_PATCHES})"


def _patches(spark, d):
    return moments.patches(_shifted(spark, d), ["vec_id", "label"], "a", "b", 8)


@query(f"SELECT position, CAST(count(*) AS BIGINT) AS pairs, round(avg(mse), 5) AS mse, round(avg(cosine), 5) AS cosine_mean, round(min(cosine), 5) AS cosine_min, round(max(cosine), 5) AS cosine_max, CAST(0 AS BIGINT) AS odd, 'PASS' AS status FROM ({_PAIRED}) GROUP BY 1")
def patch_positions(spark, d):
    """Eight patches of eight components each, vectors against shifted ones, by position, with their cosines checked."""
    out = moments.by_position(_patches(spark, d))
    return out.withColumns({c: F.round(c, 5) for c in ("mse", "cosine_mean", "cosine_min", "cosine_max")})


_PHASED = f"SELECT *, vec_id // 100 AS epoch, CASE WHEN vec_id % 5 = 0 THEN 'monitor' ELSE 'train' END AS phase FROM ({_PAIRED})"


@query(f"""WITH i AS (SELECT epoch, phase, vec_id, avg(cosine) AS m FROM ({_PHASED}) GROUP BY 1, 2, 3), g AS (SELECT epoch, phase, count(*) AS images, min(m) AS least FROM i GROUP BY 1, 2)
  SELECT CAST(epoch AS BIGINT) AS epoch, phase, CAST(max(images) AS BIGINT) AS images, CAST(count(*) AS BIGINT) AS patches, round(avg(cosine), 5) AS cosine_mean, round(stddev_pop(cosine), 5) AS cosine_std, round(min(cosine), 5) AS cosine_min, round(max(cosine), 5) AS cosine_max, round(max(least), 5) AS image_mean_min, round(avg(mse), 5) AS mse, CAST(0 AS BIGINT) AS odd
  FROM ({_PHASED}) JOIN g USING (epoch, phase) GROUP BY 1, 2""")
def alignment_epochs(spark, d):
    rows = _patches(spark, d).withColumns({"epoch": F.floor(F.col("vec_id") / 100), "phase": F.when(F.col("vec_id") % 5 == 0, "monitor").otherwise("train")})
    out = moments.epoch_rollup(rows, "epoch", "phase", "vec_id")
    return out.withColumns({c: F.round(c, 5) for c in ("cosine_mean", "cosine_std", "cosine_min", "cosine_max", "image_mean_min", "mse")})


@query(f"SELECT vec_id, CAST(count(*) AS BIGINT) AS n, round(avg(cosine), 5) AS mean_patch_cosine FROM ({_PAIRED}) GROUP BY 1")
def image_cosine(spark, d):
    """The mean cosine of each vector's patches."""
    return moments.of(_patches(spark, d), ["vec_id"], "cosine").select("vec_id", "n", F.round("mean", 5).alias("mean_patch_cosine"))


@query("""WITH c AS (SELECT event_type, user_id % 1000 AS k, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, CAST(k AS VARCHAR)) AS i FROM c)
  SELECT event_type, string_agg(k || '=' || n, ';' ORDER BY n DESC, CAST(k AS VARCHAR)) FILTER (WHERE i <= 20) AS counts, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (WHERE i > 20), 0) AS BIGINT) AS other, coalesce(CAST(max(CASE WHEN k = 7 AND i <= 20 THEN n END) AS VARCHAR), 'not in catalogue') AS of_seven FROM r GROUP BY 1""")
def counter_maps(spark, d):
    """The twenty commonest users of each kind of event as a map, what it leaves out, and a lookup in it."""
    out = counters.count_maps(table(spark, d, "events").withColumn("k", F.col("user_id") % 1000), ["event_type"], "k", 20)
    ordered = F.sort_array(F.transform(F.map_entries("counts"), lambda x: F.struct((-x["value"]).alias("m"), x["key"].alias("k"))))
    return out.select("event_type", F.array_join(F.transform(ordered, lambda x: F.concat(x["k"], F.lit("="), -x["m"])), ";").alias("counts"), "total", "other", counters.look_up(F.col("counts"), F.lit(7)).alias("of_seven"))


@query("""SELECT d.doc_id, CASE WHEN l.n IS NULL THEN 'not in catalogue' WHEN l.n > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN l.n = 1 THEN 'quality=' || q || ';toxic=' || t ELSE '' END AS payload
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, coalesce(CAST(any_value(quality) AS VARCHAR), '') AS q, coalesce(CAST(any_value(toxic) AS VARCHAR), '') AS t FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id""")
def truth_payload(spark, d):
    """Each document with what the labels say of it, as a map, or that they don't know it."""
    out = counters.payload(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", ["quality", "toxic"])
    text = F.array_join(F.transform(F.array_sort(F.map_entries("payload")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return out.select("doc_id", "status", text.alias("payload"))


def _level(i: int) -> str:
    """Sixty-four hashes of the level below as one; a source that is down to one hash keeps it."""
    return f"l{i} AS (SELECT source, node // 64 AS node, CASE WHEN max(several) THEN sha256(string_agg(hash, chr(10) ORDER BY node) || chr(10)) ELSE any_value(hash) END AS hash FROM (SELECT *, max(node) OVER (PARTITION BY source) > 0 AS several FROM l{i - 1}) GROUP BY 1, 2)"


@query(f"""WITH p AS (SELECT source, doc_id || chr(9) || coalesce(sha, '') AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM ({SPLIT_DOCS})),
  l0 AS (SELECT source, place // 64 AS node, sha256(string_agg(t, chr(10) ORDER BY place) || chr(10)) AS hash FROM p GROUP BY 1, 2), {', '.join(_level(i) for i in range(1, 6))} SELECT source, hash AS content_hash FROM l5""")
def content_hash(spark, d):
    """One digest of all (id, content hash) rows of each source, in the order of ids: a tree with 64 children a node."""
    rows = split_docs(spark, d).select("source", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.coalesce("sha", F.lit(""))).alias("t"))
    return digests.root(digests.leaves(rows, ["source"], ["doc_id"], F.col("t")), ["source"])
