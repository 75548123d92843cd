"""Queries that write tables and read them again, or read texts as reports; what they write stands in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.functions import cols
from cairn.operators import history
from cairn.operators.graph import ensure_checkpoint_dir
from cairn.plans.catalogue import _days, _DAYS, query
from cairn.plans.tables import SPLIT_DOCS, split_docs, table
from cairn.sources import files, readers, writers


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scan-{uuid.uuid4()}"


_CELLS = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, split, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars, coalesce(sha, '') AS sha FROM"


@query(f"{_CELLS} ({SPLIT_DOCS})")
def csv_splits(spark, d):
    """Each split written as checked CSV, then read as one union; cells are text."""
    docs, folder = split_docs(spark, d).select("doc_id", "lang", "source", "n_chars", "sha", "split"), _folder(spark)
    paths = {s: f"{folder}/{s}" for s in ("train", "val", "test")}
    for s, path in paths.items():
        writers.write_table(docs.where(F.col("split") == s).drop("split"), path, "csv")
    return readers.require_columns(readers.read_splits(spark, paths), ["doc_id", "split"]).select("doc_id", "split", "lang", "source", "n_chars", "sha")


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, sha256(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS sha FROM conversations")
def csv_texts(spark, d):
    """Texts with quotes, blanks and line ends through CSV; line ends come back as line feeds."""
    folder = _folder(spark)
    writers.write_table(table(spark, d, "conversations").select("conv_id", "turn", "text"), folder, "csv")
    text = F.replace(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return readers.read_csv(spark, folder).select("conv_id", "turn", F.sha2(text, 256).alias("sha"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def json_scan(spark, d):
    """Documents written as JSON lines in folders by language, scanned with the language from the folder."""
    folder = _folder(spark)
    table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", "source", "lang").write.partitionBy("lang").json(folder)
    return spark.read.json(folder).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("SELECT r_name AS key, CAST(r_regionkey AS VARCHAR) AS value FROM region UNION ALL SELECT n_name, CAST(n_nationkey AS VARCHAR) FROM nation")
def report_values(spark, d):
    """Reports of keys and values written as texts, then parsed; lines without a colon are none."""
    folder = _folder(spark)
    lines = table(spark, d, "region").select(F.concat("r_name", F.lit(": "), F.col("r_regionkey").cast("string")).alias("value")).unionByName(table(spark, d, "nation").select(F.concat("n_name", F.lit(":  "), F.col("n_nationkey").cast("string")).alias("value"))).unionByName(table(spark, d, "nation").select("n_name").toDF("value"))
    lines.write.text(folder)
    return readers.key_values(spark, folder)


@query("""WITH l AS (SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS moment, event_type FROM events), s AS (SELECT max(event_id) AS i FROM l WHERE event_type = 'error' AND event_id < (SELECT max(event_id) FROM l WHERE event_type = 'click'))
  SELECT CAST(epoch((SELECT moment FROM l WHERE event_type = 'click' AND event_id > i ORDER BY event_id LIMIT 1)) - epoch((SELECT moment FROM l WHERE event_id = i)) AS BIGINT) AS seconds FROM s""")
def log_seconds(spark, d):
    """Seconds from the last error before the last click to the click after it, from lines of a log."""
    e = table(spark, d, "events")
    last = e.where("event_type = 'click'").agg(F.max("event_id").alias("m"))
    lines = e.join(F.broadcast(last), F.col("event_id") <= F.col("m")).select("event_id", F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), "event_type").alias("value"))
    return readers.wall_seconds(lines, "error", "click", "event_id")


@query("SELECT url AS path, stem, CAST(c AS BIGINT) AS copies FROM (SELECT *, count(*) OVER (PARTITION BY stem) AS c FROM (SELECT url, regexp_extract(url, '([^/]+?)(?:\\.[^./]+)?$', 1) AS stem FROM pages)) WHERE c > 1")
def stem_members(spark, d):
    """Pages whose address ends like another's; `path_stems` lists them in one row a stem."""
    return readers.stem_members(table(spark, d, "pages"), "url")


_NAME = "l_orderkey || '_class' || l_linenumber || CASE WHEN l_partkey % 2 = 0 THEN '_radR' || l_partkey % 9 ELSE '' END || '_bbox' || l_suppkey || CASE WHEN l_returnflag = 'A' THEN '__aug_brightness_' || l_partkey || '_f097' ELSE '' END || CASE WHEN l_linestatus = 'F' THEN '.png' ELSE '' END"


@query(f"""WITH n AS (SELECT *, {_NAME} AS name FROM lineitem) SELECT name, CASE WHEN l_linestatus = 'F' THEN CAST(l_orderkey AS VARCHAR) ELSE '' END AS source_image_id, CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS INT) END AS class_id, CASE WHEN l_linestatus = 'F' AND l_partkey % 2 = 0 THEN 'R' || l_partkey % 9 ELSE '' END AS rad_id, CASE WHEN l_linestatus = 'F' THEN CAST(l_suppkey AS INT) END AS annotation_index,
  l_linestatus = 'F' AND l_returnflag = 'A' AS augmented, split_part(replace(name, '.png', ''), '__aug_brightness_', 1) AS original_roi_id FROM n""")
def file_names(spark, d):
    """Names of crops taken apart: source, class, parts, and the name without its augmentation; names without an ending don't parse."""
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    rows = spark.sql(f"SELECT {_NAME} AS name FROM lineitem")
    return rows.select("name", *(c.alias(k) for k, c in cols.roi_name(F.col("name")).items()))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS top FROM embeddings")
def argmax_rows(spark, d):
    return table(spark, d, "embeddings").select("vec_id", cols.argmax(F.col("embedding")).alias("top"))


@query(f"SELECT event_type, epoch, v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v, epoch) AS i FROM ({_DAYS})) WHERE i = 1")
def least_loss_epoch(spark, d):
    """The step of the least value; of equal ones the first."""
    return history.best_row(_days(spark, d), ["event_type"], [F.asc("v"), F.asc("epoch")])


@query(f"""WITH s AS (SELECT *, max(v) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_DAYS})) SELECT event_type, epoch, v, before IS NULL OR v > before AS is_best FROM s""")
def strict_gains(spark, d):
    """Steps that are strictly better than all before."""
    return history.strict_gains(_days(spark, d), ["event_type"], "epoch", "v")


@query(f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (lang IS NULL OR trim(lang) = '') + count(*) FILTER (source IS NULL OR trim(source) = '') AS BIGINT) AS blank, CAST(0 AS BIGINT) AS non_finite, (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM documents GROUP BY lang, source)) AS repeated FROM documents")
def table_defects(spark, d):
    """What a strict writer would refuse in the languages and sources of documents."""
    found = writers.defects(table(spark, d, "documents").select("lang", "source"))
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


@query(f"SELECT sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size, 'utf-8-sig' AS encoding FROM benchmark WHERE text IS NOT NULL")
def whole_texts(spark, d):
    """The benchmark's texts as files of their own, each read whole in the first encoding that takes it."""
    folder, texts = _folder(spark), table(spark, d, "benchmark").where("text IS NOT NULL").select("text")
    texts.repartition(max(1, texts.count())).write.option("lineSep", "\u0001").text(folder)
    held = files.read_texts(spark, f"{folder}/part-*").withColumn("t", F.explode(F.array_remove(F.split("text", "\u0001"), "")))
    return held.select(F.sha2("t", 256).alias("sha256"), F.length(F.encode("t", "UTF-8")).cast("long").alias("size"), "encoding")


@query("""SELECT user_id, strftime(min(ts), '%Y%m%d_%H%M%S') AS first_slug, strftime(max(ts), '%Y%m%d_%H%M%S') AS last_slug, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE, 3) AS seconds, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS INT) AS days FROM events GROUP BY 1""")
def user_spans(spark, d):
    """The first and last moment of each user, written as text and read again, as slugs and differences."""
    text = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("t"))
    spans = text.withColumn("at", cols.moment(F.col("t"))).groupBy("user_id").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    return spans.select("user_id", cols.slug(F.col("a")).alias("first_slug"), cols.slug(F.col("b")).alias("last_slug"), F.round(cols.seconds_between(F.col("a"), F.col("b")), 3).alias("seconds"), F.datediff("b", "a").alias("days"))
