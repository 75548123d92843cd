"""Annotations of images: normalised rows, one verdict for each in a fixed order, and counts by class and by image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import cols
from cairn.operators.relate import grid, joined

BOX = ("x0", "y0", "x1", "y1")
#: Verdicts that come before those of the box.
DUPLICATE, MISSING, UNREADABLE = "duplicate_annotation", "missing_image", "image_read_error"


def normalise(rows: DataFrame, names: DataFrame, class_id: str = "class_id", class_name: str = "class_name", numbers: tuple[str, ...] = BOX) -> DataFrame:
    """Rows with a whole class id, boxes as numbers (NaN where the text is none), and a class name: the given one, or that of ``names`` (class_id, name).

    Nothing raises: what can't be read is null or NaN, and later rules name it. A blank name counts as none.
    """
    casts = {c: cols.parse_double(F.trim(F.col(c).cast("string"))) for c in numbers}
    cast = rows.withColumns({class_id: cols.parse_int_strict(F.col(class_id).cast("string"))} | casts)
    known = names.groupBy(F.col("class_id").cast("int").alias("_id")).agg(F.min("name").alias("_name"))
    out = cast.join(known, F.col(class_id) == F.col("_id"), "left")
    own = F.trim(F.col(class_name))
    return out.withColumn(class_name, F.when(own != "", own).otherwise(F.col("_name"))).drop("_id", "_name")


def with_manifest(rows: DataFrame, manifest: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All rows with ``columns`` of the manifest's row of their key and ``in_manifest``: yes, no, or several where it has more than one.

    The manifest is reduced to one row a key first, so rows never multiply; of several, each column's least value stands.
    """
    one = manifest.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), *(F.min(c).alias(c) for c in columns))
    out = rows.join(one, key, "left")
    return out.withColumn("in_manifest", F.when(F.col("_n").isNull(), "no").when(F.col("_n") > 1, "several").otherwise("yes")).drop("_n")


def audit(rows: DataFrame, images: DataFrame, key: list[str], image: str, order: str) -> DataFrame:
    """Rows with ``reason`` (empty where a row is valid), ``needs_clamp`` and the clamped edges; the first rule that holds names the reason.

    In this order: duplicate_annotation (an earlier row by ``order`` has the key), missing_image (``images`` lacks it),
    image_read_error (``images`` gives an ``error``), then why the box is invalid within the image's own ``width`` and
    ``height``. So a duplicate of a row whose image is missing is a duplicate. Null parts of a key are values like others.
    ``order`` puts rows of a key in order (several columns as a struct), nulls last; of rows that are equal in it, one is the first.
    The first row of each key is found before rows meet it, so a frequent key is summed where it stands; only rows that are equal
    in key and order are numbered together.
    """
    first = rows.groupBy(*key).agg(F.min(order).alias("_first"))
    copy = F.row_number().over(W.partitionBy(*key, order).orderBy(F.lit(1)))
    marked = joined(rows.withColumn("_copy", copy), first, key).withColumn("_late", ~F.col("_first").eqNullSafe(F.col(order)) | (F.col("_copy") > 1)).drop("_first", "_copy")
    own = images.groupBy(image).agg(*(F.min(c).alias(f"_{c}") for c in ("width", "height", "error")), F.lit(True).alias("_there"))
    out = marked.join(own, image, "left")
    edges = [F.col(c) for c in (*BOX, "_width", "_height")]
    reason = F.when(F.col("_late"), DUPLICATE).when(F.col("_there").isNull(), MISSING).when(F.coalesce("_error", F.lit("")) != "", UNREADABLE).otherwise(cols.box_reason(*edges))
    clamp = F.coalesce(cols.needs_clamp(*edges), F.lit(False)) & ~reason.isin(DUPLICATE, MISSING, UNREADABLE)
    return out.withColumn("reason", reason).withColumn("needs_clamp", clamp).withColumns(cols.clamp_box(*edges)).drop("_late", "_width", "_height", "_error", "_there")


def routed(audited: DataFrame) -> dict[str, DataFrame]:
    """The rows of ``audit`` by where they go: valid, clamped (valid ones that need it), duplicate, missing, unreadable, invalid.

    The table should be stored before several of them are written, since each reads it.
    """
    reason = F.col("reason")
    return {
        "valid": audited.where(reason == ""),
        "clamped": audited.where((reason == "") & F.col("needs_clamp")),
        "duplicate": audited.where(reason == DUPLICATE),
        "missing": audited.where(reason == MISSING),
        "unreadable": audited.where(reason == UNREADABLE),
        "invalid": audited.where(~reason.isin("", DUPLICATE, MISSING, UNREADABLE)),
    }


def _tallies() -> list[Column]:
    reason = F.col("reason")
    return [F.count("*").alias("annotations"), F.count_if(reason == "").alias("valid"), F.count_if(reason == DUPLICATE).alias("duplicate"), F.count_if(reason == MISSING).alias("missing"), F.count_if(~reason.isin("", DUPLICATE, MISSING)).alias("invalid")]


def class_counts(audited: DataFrame, image: str, splits: list, classes: list, split: str = "split", label: str = "class_id") -> DataFrame:
    """(split, class, annotations, valid, duplicate, missing, invalid, images) for every split and class, zeros included.

    ``annotations`` counts all rows, duplicates too; ``images`` counts different images of valid rows.
    """
    counts = audited.groupBy(split, label).agg(*_tallies(), F.count_distinct(F.when(F.col("reason") == "", F.col(image))).alias("images"))
    return grid(counts, {split: splits, label: classes}, ["annotations", "valid", "duplicate", "missing", "invalid", "images"])


def image_counts(audited: DataFrame, image: str, label: str = "class_id") -> DataFrame:
    """(image, annotations, valid, duplicate, missing, invalid, classes, n_classes, single) of each image.

    ``classes`` lists the different classes of its valid rows in order; ``single`` holds where there is one.
    """
    out = audited.groupBy(image).agg(*_tallies(), F.array_sort(F.collect_set(F.when(F.col("reason") == "", F.col(label)))).alias("classes"))
    return out.withColumn("n_classes", F.size("classes").cast("long")).withColumn("single", F.col("n_classes") == 1)
