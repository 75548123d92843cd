"""Reviews of crops: what is wrong with a table of reviews, and a manifest with what its reviews decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a review must have, the one of them that may be blank, the statuses, and how a name gives its box.
REQUIRED = ("crop_path", "source_image_id", "split", "class_id", "class_name", "annotation_index", "review_status", "technical_issue", "review_note")
MAY_BE_BLANK, STATUSES, BOX_IN_NAME = ("review_note",), ("pass", "fail", "uncertain"), r"(?i)_bbox(\d+)\.png$"
KEY = ("split", "source_image_id", "class_id", "annotation_index")


def plain(c: Column | str) -> Column:
    """Without blanks around it; a null is an empty text."""
    return F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))


def plain_path(c: Column | str) -> Column:
    return F.replace(plain(c), F.lit("\\"), F.lit("/"))


def box_of(path: Column) -> Column:
    """The number after ``_bbox`` in a file's name, or null."""
    return F.regexp_extract(path, BOX_IN_NAME, 1).try_cast("long")


def row_errors(rows: DataFrame, row: str, statuses: tuple[str, ...] = STATUSES, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(row, error, detail) of what each review row has wrong by itself.

    missing_<column> for a blank required one, invalid_review_status, then one of missing_bbox_index_in_filename,
    invalid_annotation_index, annotation_index_filename_mismatch. A table without a required column gives one row (row
    null) with missing_required_column and the names, and nothing else is looked at.
    """
    absent = [c for c in required if c not in rows.columns]
    if absent:
        return rows.sparkSession.createDataFrame([(None, "missing_required_column", ";".join(absent))], f"{row} {rows.schema[row].dataType.simpleString()}, error string, detail string")
    fault = lambda when, name, detail: F.when(when, F.struct(F.lit(name).alias("error"), detail.cast("string").alias("detail")))
    status, told, named = F.lower(plain("review_status")), plain("annotation_index").try_cast("long"), box_of(plain_path("crop_path"))
    faults = [fault(plain(c) == "", f"missing_{c}", F.lit(f"{c} is blank")) for c in required if c not in MAY_BE_BLANK]
    faults.append(fault((status != "") & ~status.isin(*statuses), "invalid_review_status", plain("review_status")))
    faults.append(
        F.coalesce(
            fault(named.isNull(), "missing_bbox_index_in_filename", plain_path("crop_path")),
            fault(told.isNull(), "invalid_annotation_index", plain("annotation_index")),
            fault(told != named, "annotation_index_filename_mismatch", F.concat_ws(" and ", told, named)),
        )
    )
    return rows.select(row, F.inline(F.array_compact(F.array(*faults))))


def _several(rows: DataFrame, key: Column, row: str, error: str, of: Column) -> DataFrame:
    """A row for each member of a group with several different ``of``; the group is found first, members meet its number."""
    keyed = rows.select(row, key.alias("_k"), of.alias("_of")).where("_k IS NOT NULL")
    groups = keyed.groupBy("_k").agg(F.count("*").alias("n"), F.count_distinct("_of").alias("d")).where("d > 1")
    return keyed.join(groups.select("_k", "n"), "_k").select(row, F.lit(error).alias("error"), F.concat_ws(" of ", F.lit("one"), F.col("n").cast("string")).alias("detail"))


def review_errors(rows: DataFrame, row: str, statuses: tuple[str, ...] = STATUSES, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``row_errors`` and, for each row concerned, duplicate_crop_path (several rows of a path) and duplicate_annotation_index
    (rows of one annotation with different paths). Groups are counted, not listed, so a frequent path is no large row."""
    errors = row_errors(rows, row, statuses, required)
    if any(c not in rows.columns for c in required):
        return errors
    path = F.when(plain_path("crop_path") != "", plain_path("crop_path"))
    whole = F.lit(True)
    for c in KEY:
        whole = whole & (plain(c) != "")
    annotation = F.when(whole, F.concat_ws("\x1f", *map(plain, KEY)))
    return errors.unionByName(_several(rows, path, row, "duplicate_crop_path", F.col(row))).unionByName(_several(rows, annotation, row, "duplicate_annotation_index", path))


def against_manifest(rows: DataFrame, manifest: DataFrame, row: str, fields: tuple[str, ...] = ("source_image_id", "split", "class_id", "class_name", "annotation_index")) -> DataFrame:
    """(row, error, detail) of repaired review rows against the manifest of crops, by path.

    crop_path_missing_from_manifest; manifest_field_mismatch with the names of the fields that differ as text; and
    annotation_index_filename_mismatch. A path that the manifest has several times is ambiguous_manifest_path, and its
    fields aren't compared.
    """
    known = manifest.groupBy(plain_path("crop_path").alias("_p")).agg(F.count("*").alias("_n"), *(F.first(plain(f)).alias(f"_{f}") for f in fields))
    met = rows.withColumn("_path", plain_path("crop_path")).join(known, F.col("_path") == F.col("_p"), "left")
    differ = F.array_join(F.array_compact(F.array(*(F.when(plain(f) != F.col(f"_{f}"), F.lit(f)) for f in fields))), ";")
    fault = lambda when, name, detail: F.when(when, F.struct(F.lit(name).alias("error"), detail.cast("string").alias("detail")))
    told, named = plain("annotation_index").try_cast("long"), box_of(F.col("_path"))
    first = F.coalesce(fault(F.col("_n").isNull(), "crop_path_missing_from_manifest", F.col("_path")), fault(F.col("_n") > 1, "ambiguous_manifest_path", F.col("_n")), fault(differ != "", "manifest_field_mismatch", differ))
    name = fault(F.col("_n").isNotNull() & (named.isNull() | ~told.eqNullSafe(named)), "annotation_index_filename_mismatch", F.concat_ws(" and ", told, named))
    return met.select(row, F.inline(F.array_compact(F.array(first, name))))


def summary(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: rows, rows_with_errors, errors, and a count of each kind as a map; PASS where there are rows and no errors."""
    row = errors.columns[0]
    kinds = errors.groupBy("error").agg(F.count("*").alias("n"))
    told = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("errors"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("error", "n")))).alias("kinds"))
    out = rows.agg(F.count("*").alias("rows")).crossJoin(errors.agg(F.count_distinct(row).alias("rows_with_errors"))).crossJoin(told)
    return out.withColumn("status", F.when((F.col("rows") > 0) & (F.col("errors") == 0), "PASS").otherwise("FAIL"))


def with_reviews(manifest: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every crop of a manifest with manual_review_status, technical_issue, review_note, include_for_model and exclusion_reason.

    A crop without a review is not_sampled and included; one whose review is fail is excluded as manual_review_fail. Of
    several reviews of a path that with the greatest ``row`` stands, as a later line replaces an earlier one.
    """
    last = reviews.groupBy(plain_path("crop_path").alias("_p")).agg(F.max_by(F.struct(F.lower(plain("review_status")).alias("s"), plain("technical_issue").alias("i"), plain("review_note").alias("n")), "row").alias("_r"))
    out = manifest.withColumn("crop_path", plain_path("crop_path")).join(last, F.col("crop_path") == F.col("_p"), "left")
    failed = F.coalesce(F.col("_r.s") == "fail", F.lit(False))
    columns = {"manual_review_status": F.coalesce("_r.s", F.lit("not_sampled")), "technical_issue": F.coalesce("_r.i", F.lit("")), "review_note": F.coalesce("_r.n", F.lit("")), "include_for_model": ~failed, "exclusion_reason": F.when(failed, "manual_review_fail").otherwise("")}
    return out.withColumns(columns).drop("_p", "_r")
