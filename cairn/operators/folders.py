"""Contracts of folders: which files stand there, which should, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The mark before a text in UTF-8, endings of files that a writer left behind, and first bytes of image kinds.
BOM, STRAY, SIGNATURES = b"\xef\xbb\xbf", (".tmp", ".writing"), {"png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff", "jpeg": b"\xff\xd8\xff"}


def _ends(path: Column, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | F.endswith(F.lower(path), F.lit(e))
    return out


def contract_faults(files: DataFrame, expected: DataFrame, marked: tuple[str, ...] = (".csv",)) -> DataFrame:
    """(path, fault) of a listing (``file_tree``) against ``expected`` (path): missing, unexpected, empty, stray, no_mark.

    no_mark: a file with one of the endings ``marked`` that doesn't begin with the mark of UTF-8. A file may have several
    faults; folders have none.
    """
    held = files.where("kind = 'file'")
    no_mark = _ends(F.col("path"), marked) & (F.substring("head", 1, len(BOM)) != F.lit(bytes(BOM)))
    own = held.join(expected.select("path", F.lit(True).alias("_wanted")).distinct(), "path", "left")
    found = F.array_compact(F.array(F.when(F.col("_wanted").isNull(), "unexpected"), F.when(F.col("size") == 0, "empty"), F.when(_ends(F.col("path"), STRAY), "stray"), F.when(no_mark, "no_mark")))
    missing = expected.select("path").distinct().join(held.select("path"), "path", "left_anti").withColumn("fault", F.lit("missing"))
    return own.select("path", F.explode(found).alias("fault")).unionByName(missing)


def contract_checks(files: DataFrame, expected: DataFrame, marked: tuple[str, ...] = (".csv",)) -> DataFrame:
    """(check, passed, n) for each kind of fault and for the number of files; ``gate`` in ``compare`` turns them into one verdict."""
    kinds = ("missing", "unexpected", "empty", "stray", "no_mark")
    counted = contract_faults(files, expected, marked).agg(*(F.count_if(F.col("fault") == k).alias(k) for k in kinds))
    sizes = files.agg(F.count_if(F.col("kind") == "file").alias("held")).crossJoin(expected.agg(F.count_distinct("path").alias("wanted")))
    rows = [F.struct(F.lit(f"no_{k}" if k != "no_mark" else "all_marked").alias("check"), (F.col(k) == 0).alias("passed"), F.col(k).alias("n")) for k in kinds]
    rows.append(F.struct(F.lit("file_count").alias("check"), (F.col("held") == F.col("wanted")).alias("passed"), F.col("held").alias("n")))
    return counted.crossJoin(sizes).select(F.inline(F.array(*rows)))


def png_size(head: Column) -> Column:
    """Width and height from the first 24 bytes of a PNG, without its pixels; null if they aren't a PNG's."""
    number = lambda at: F.conv(F.hex(F.substring(head, at, 4)), 16, 10).cast("long")
    first = SIGNATURES["png"] + b"\x00\x00\x00\rIHDR"
    size = F.struct(number(17).alias("width"), number(21).alias("height"))
    return F.when((F.substring(head, 1, len(first)) == F.lit(bytes(first))) & (F.octet_length(head) >= 24), size)


def image_faults(manifest: DataFrame, files: DataFrame, path: str, width: int, height: int, status: str | None = None) -> DataFrame:
    """(path, fault, detail) of the images that a manifest names, from a listing with at least 24 first bytes (``file_tree``).

    duplicate_output_path (detail: rows), failed_status (a status other than success), missing_image, empty_image,
    unreadable_image (no PNG by its first bytes), wrong_size (detail: the size). Paths are compared in lower case with
    slashes; pixels aren't read, so an image of one colour isn't found.
    """
    rows = manifest.withColumn("_path", F.lower(F.replace(F.trim(F.col(path)), F.lit("\\"), F.lit("/"))))
    held = files.where("kind = 'file'").select(F.lower("path").alias("_path"), "size", "head").dropDuplicates(["_path"])
    several = rows.groupBy("_path").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_path").alias("path"), F.lit("duplicate_output_path").alias("fault"), F.col("n").cast("string").alias("detail"))
    size = png_size(F.col("head"))
    fault = F.when(F.col("size").isNull(), "missing_image").when(F.col("size") == 0, "empty_image").when(size.isNull(), "unreadable_image").when((size["width"] != width) | (size["height"] != height), "wrong_size")
    detail = F.when(fault == "wrong_size", F.concat_ws("x", size["width"], size["height"])).otherwise("")
    own = rows.select("_path").distinct().join(held, "_path", "left").select(F.col("_path").alias("path"), fault.alias("fault"), detail.alias("detail")).where("fault IS NOT NULL")
    out = several.unionByName(own)
    if status:
        failed = rows.where(~F.lower(F.trim(status)).eqNullSafe("success"))
        out = out.unionByName(failed.select(F.col("_path").alias("path"), F.lit("failed_status").alias("fault"), F.coalesce(status, F.lit("")).alias("detail")))
    return out


def folder_faults(files: DataFrame, manifest: DataFrame, folders: list[str], forbidden: list[str], counts: dict[str, int] | None = None, path: str = "path", key: tuple[str, ...] = ()) -> DataFrame:
    """(subject, fault, detail) of a folder of class folders against its manifest; ``path`` is from the folder's root.

    Of folders at the top: unexpected_class_folder, missing_class_folder, forbidden_split_folder. Of manifest rows:
    duplicate_manifest_path and duplicate_key (by lower-cased path, by ``key``; detail is the number of rows), missing_file,
    empty_file, bad_signature (the first bytes aren't those of the file's ending). Of classes, which are the first part of
    a path: class_count_mismatch, where ``counts`` says how many rows a class should have.
    """
    spark = files.sparkSession
    none = F.lit("").alias("detail")
    top = files.where("kind = 'folder' AND NOT contains(path, '/')").select("path")
    wanted = spark.createDataFrame([(f,) for f in folders], "path string")
    out = [
        top.join(wanted, "path", "left_anti").select(F.col("path").alias("subject"), F.lit("unexpected_class_folder").alias("fault"), none),
        wanted.join(top, "path", "left_anti").select(F.col("path").alias("subject"), F.lit("missing_class_folder").alias("fault"), none),
        top.where(F.col("path").isin(forbidden)).select(F.col("path").alias("subject"), F.lit("forbidden_split_folder").alias("fault"), none),
    ]
    rows = manifest.withColumn("_path", F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/"))))
    several = lambda by, name: rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws("/", *(F.col(b).cast("string") for b in by)).alias("subject"), F.lit(name).alias("fault"), F.col("n").cast("string").alias("detail"))
    out.append(several(["_path"], "duplicate_manifest_path"))
    if key:
        out.append(several(list(key), "duplicate_key"))
    held = files.where("kind = 'file'").select(F.lower("path").alias("_path"), "size", "head").dropDuplicates(["_path"])
    ending, wrong = F.regexp_extract("_path", r"\.([^./]+)$", 1), F.lit(False)
    for name, first in SIGNATURES.items():
        wrong = wrong | ((ending == name) & (F.substring("head", 1, len(first)) != F.lit(bytes(first))))
    fault = F.when(F.col("size").isNull(), "missing_file").when(F.col("size") == 0, "empty_file").when(wrong, "bad_signature")
    out.append(rows.select("_path").distinct().join(held, "_path", "left").select(F.col("_path").alias("subject"), fault.alias("fault"), none).where("fault IS NOT NULL"))
    if counts:
        want = spark.createDataFrame(list(counts.items()), "subject string, want long")
        have = rows.groupBy(F.regexp_extract("_path", "^([^/]+)/", 1).alias("subject")).agg(F.count("*").alias("n"))
        off = want.join(have, F.lower(want["subject"]) == have["subject"], "left").select(want["subject"], F.coalesce("n", F.lit(0)).alias("n"), "want").where("n <> want")
        out.append(off.select("subject", F.lit("class_count_mismatch").alias("fault"), F.concat_ws(" of ", F.col("n").cast("string"), F.col("want").cast("string")).alias("detail")))
    every = out[0]
    for one in out[1:]:
        every = every.unionByName(one)
    return every
