"""Readers of tables, reports and file trees. All use Spark's own readers, so any of its file systems will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.cols import roi_name
from cairn.operators.folders import png_size
from cairn.operators.relate import numbered
from cairn.operators.validate import first_violation

#: Suffixes that count as images.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "dicom", "dcm")


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, as the files hold them; empty cells are empty strings."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.fillna("")


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    out = None
    for split, path in paths.items():
        one = read_csv(spark, path).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def id_set(spark: SparkSession, paths: list[str], column: str) -> DataFrame:
    """(id) of the different values of a column in CSV files of which some may be absent or lack it; blanks are none.

    Whether a path exists is asked of its own file system, so any that Spark reads will do.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = spark.createDataFrame([], "id string")
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            rows = read_csv(spark, path)
            if column in rows.columns:
                out = out.unionByName(rows.select(F.trim(column).alias("id")))
    return out.where("id <> ''").distinct()


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def file_index(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(stem, path, copies) of files under a folder; of equal stems, the first path stands."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)\.([^./]+)$", 1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(suffix.isin(*suffixes)).groupBy(name.alias("stem")).agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the lines of a report that hold a colon and a space."""
    parts = F.split("value", ": ", 2)
    return spark.read.text(path).where(F.col("value").contains(": ")).select(F.trim(F.get(parts, 0)).alias("key"), F.trim(F.get(parts, 1)).alias("value"))


def wall_seconds(lines: DataFrame, start: str, stop: str, order: str = "line_no", text: str = "value") -> DataFrame:
    """Seconds from the last line that holds ``start`` to the first one after it that holds ``stop``, by [timestamps]."""
    at = F.try_to_timestamp(F.regexp_extract(text, r"^\[([^\]]+)\]", 1))
    marked = lines.withColumn("_at", at).where(F.col(text).contains(start) | F.col(text).contains(stop))
    last = F.max(F.when(F.col(text).contains(start), F.col(order))).over(W.partitionBy(F.lit(0)))
    later = marked.withColumn("_last", last).where(F.col(order) >= F.col("_last"))
    begin = F.max(F.when(F.col(order) == F.col("_last"), F.col("_at")))
    end = F.min_by("_at", F.when(F.col(text).contains(stop) & (F.col(order) > F.col("_last")), F.col(order)))
    return later.agg((F.unix_timestamp(end) - F.unix_timestamp(begin)).alias("seconds"))


def stems(files: DataFrame, path: str = "path") -> DataFrame:
    """(stem, copies, paths) of files by their name without its suffix; ``paths`` lists them where there are several."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)
    out = files.groupBy(stem.alias("stem")).agg(F.count("*").alias("copies"), F.array_sort(F.collect_list(path)).alias("paths"))
    return out.withColumn("paths", F.when(F.col("copies") > 1, F.col("paths")))


def stem_members(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, stem, copies) of the files whose stem several files share: a row a file, so a frequent stem is no large row."""
    named = files.select(F.col(path).alias("path"), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1).alias("stem"))
    several = named.groupBy("stem").agg(F.count("*").alias("copies")).where("copies > 1")
    return named.join(several, "stem").select("path", "stem", "copies")


def _judged(files: DataFrame, suffixes: tuple[str, ...], more: dict) -> DataFrame:
    """Files (path and more) with class_folder, the parts of their names, and the first reason why one is unsound."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    folder = F.regexp_extract("path", r"(\d+)[^/]*/[^/]+$", 1).try_cast("int")
    parts = files.withColumns({"class_folder": folder} | roi_name(name))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rules = {"suffix": ~suffix.isin(*suffixes), "empty": F.col("length") == 0, "name": F.col("class_id").isNull(), "class": ~F.col("class_folder").eqNullSafe(F.col("class_id"))}
    return parts.withColumn("reason", first_violation(rules | more))


def class_folders(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, files: DataFrame | None = None) -> DataFrame:
    """Images in folders named by class: path, length, class_folder, the parts of each name, and ``reason``, why a file is unsound.

    Reasons: suffix, empty, name (it doesn't parse), class (the folder's number isn't the name's). Only paths and sizes are
    read. Spark's file source lists no file without bytes; a listing by ``file_tree``, given as ``files``, has those too.
    """
    if files is not None:
        listed = files.where("kind = 'file'").select("path", F.col("size").alias("length"))
    else:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return _judged(listed, suffixes, {})


def balanced_scan(spark: SparkSession, root: str, width: int, height: int, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """Every image below ``root`` with its digest, its size by its first bytes, its lineage and its verdict: one row a file.

    Columns: path, length, sha256, width, height, class_folder, source_image_id, class_id, rad_id, annotation_index,
    augmented, original_roi_id, reason, and feature_index, the place among sound files by path. reason is one of
    ``class_folders``, then unreadable (no PNG by its first bytes), wrong_size, or original (an augmented file whose original
    isn't among the sound files). Files are hashed where they are read; their bytes aren't shuffled.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    size = png_size(F.substring("content", 1, 24))
    read = files.select("path", "length", F.sha2("content", 256).alias("sha256"), size["width"].alias("width"), size["height"].alias("height"))
    judged = _judged(read, suffixes, {"unreadable": F.col("width").isNull(), "wrong_size": (F.col("width") != width) | (F.col("height") != height)})
    own = judged.where("reason = '' AND NOT augmented").select("original_roi_id", F.lit(True).alias("_there")).distinct()
    whole = judged.join(own, "original_roi_id", "left")
    whole = whole.withColumn("reason", F.when((F.col("reason") == "") & F.col("augmented") & F.col("_there").isNull(), "original").otherwise(F.col("reason")))
    whole = whole.select(*judged.columns).withColumn("_sound", F.col("reason") == "")
    placed = numbered(whole, ["_sound"], ["path"], "feature_index")
    return placed.withColumn("feature_index", F.when(F.col("_sound"), F.col("feature_index"))).drop("_sound")
