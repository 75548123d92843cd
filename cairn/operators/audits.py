"""Audits of whole sets: counts under names, what they should be, and reports made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.relate import joined


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def measures(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(name, value) of some aggregates of a table, all from one scan; a null is 0."""
    values = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias("value")) for n, c in named.items()))
    return rows.agg(values.alias("x")).select(F.inline("x"))


def pinned(measured: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, expected, value, passed) of every expected number; one that wasn't measured fails with a null value."""
    want = measured.sparkSession.createDataFrame(list(expected.items()), "name string, expected long")
    return want.join(measured, "name", "left").select("name", "expected", "value", F.coalesce(F.col("value") == F.col("expected"), F.lit(False)).alias("passed"))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """(rows, groups, beyond_first): how many rows stand in groups of several with equal keys, such groups, and rows beyond each first one."""
    groups = rows.groupBy(*key).agg(F.count("*").alias("_copies")).where("_copies > 1")
    return groups.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"), F.count("*").alias("groups"), F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("beyond_first"))


def _one(frame: DataFrame, column: str, name: str) -> DataFrame:
    return frame.select(F.lit(name).alias("name"), F.col(column).cast("long").alias("value"))


def catalogue(images: DataFrame, annotations: DataFrame, names: dict[int, str], most_named: int = 20) -> DataFrame:
    """(name, value) about ``images`` (image_id, sha256, error) and ``annotations`` (image_id, class_id, class_name).

    Annotations count as valid where the id isn't blank and the class's number and name belong together. Named counts:
    raw_image_count, annotation_rows, unique_annotation_image_id_count, manifest_rows (readable ids), missing_image_count
    (annotated ids without an image), image_without_annotation_count, unreadable_image_count, invalid_label_count,
    duplicate_image_id_count, duplicate_sha256_group_count, duplicate_annotation_row_count (rows beyond the first).
    """
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    told = annotations.select(*(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("image_id", "class_id", "class_name")))
    valid = (F.col("image_id") != "") & F.coalesce(F.try_element_at(known, F.col("class_id").try_cast("int")) == F.col("class_name"), F.lit(False))
    ids = images.groupBy(F.col("image_id").cast("string").alias("image_id")).agg(F.count("*").alias("copies"), F.min(F.coalesce("error", F.lit(""))).alias("error"), F.min("sha256").alias("sha256"))
    annotated = told.where(valid).select("image_id").distinct()
    met = joined(ids.withColumn("there", F.lit(True)), annotated.withColumn("named", F.lit(True)), ["image_id"], "full_outer")
    readable = F.col("there") & (F.col("error") == "")
    return stacked(
        [
            measures(images, {"raw_image_count": F.count("*")}),
            measures(told, {"annotation_rows": F.count("*"), "invalid_label_count": F.count_if(~valid)}),
            measures(met, {"unique_annotation_image_id_count": F.count_if("named"), "manifest_rows": F.count_if(readable), "missing_image_count": F.count_if(F.col("there").isNull()), "image_without_annotation_count": F.count_if(F.col("named").isNull()), "unreadable_image_count": F.count_if(F.col("there") & (F.col("error") != "")), "duplicate_image_id_count": F.count_if(F.col("copies") > 1)}),
            _one(repeated(ids.where((F.col("error") == "") & F.col("sha256").isNotNull()), ["sha256"]), "groups", "duplicate_sha256_group_count"),
            _one(repeated(told, told.columns), "beyond_first", "duplicate_annotation_row_count"),
        ]
    )


#: Counts of which each must be 0 for a balanced set to pass.
BALANCED_FAULTS = ("unreadable_image_count", "zero_byte_file_count", "duplicate_path_count", "duplicate_filename_within_class_count", "missing_class_id_count", "invalid_class_id_count", "missing_source_image_id_count", "source_image_id_not_in_metadata_count", "augmented_without_source_count")


def balanced_set(rows: DataFrame, sources: DataFrame, classes: list, per_class: int) -> DataFrame:
    """(name, value) about the rows of a balanced set, and ``status`` as 1 for PASS.

    ``rows`` has path, file_name, class_id, source_image_id, original_roi_id, augmented, feature_index, size, error and
    sha256; ``sources`` the known source_image_id. PASS: every class has ``per_class`` rows, indices are 0 to the number of
    rows, each once, and none of BALANCED_FAULTS was found. Repeated contents are counted but don't fail.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    bad_class = ~F.coalesce(F.col("class_id").isin(classes), F.lit(False))
    own = measures(
        rows,
        {
            "total_count": F.count("*"),
            "unreadable_image_count": F.count_if(~blank("error")),
            "zero_byte_file_count": F.count_if(F.col("size") == 0),
            "missing_class_id_count": F.count_if(F.col("class_id").isNull()),
            "invalid_class_id_count": F.count_if(bad_class & F.col("class_id").isNotNull()),
            "missing_source_image_id_count": F.count_if(blank("source_image_id")),
            "augmented_image_count": F.count_if("augmented"),
            "augmented_without_source_count": F.count_if(F.col("augmented") & blank("original_roi_id")),
            "feature_index_min": F.min("feature_index"),
            "feature_index_max": F.max("feature_index"),
            "feature_index_distinct": F.count_distinct("feature_index"),
            **{f"class_{c}_count": F.count_if(F.col("class_id") == c) for c in classes},
        },
    )
    unknown = rows.where(~blank("source_image_id")).join(sources.select("source_image_id").distinct(), "source_image_id", "left_anti")
    out = stacked(
        [
            own,
            measures(unknown, {"source_image_id_not_in_metadata_count": F.count("*")}),
            _one(repeated(rows.where("path IS NOT NULL"), ["path"]), "beyond_first", "duplicate_path_count"),
            _one(repeated(rows, ["class_id", "file_name"]), "beyond_first", "duplicate_filename_within_class_count"),
            _one(repeated(rows.where("sha256 IS NOT NULL"), ["sha256"]), "groups", "duplicate_sha256_group_count"),
            _one(repeated(rows.where("sha256 IS NOT NULL"), ["sha256"]), "rows", "duplicate_sha256_image_count"),
        ]
    )
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    sound = (value("feature_index_min") == 0) & (value("feature_index_max") == value("total_count") - 1) & (value("feature_index_distinct") == value("total_count"))
    for n in BALANCED_FAULTS:
        sound = sound & (value(n) == 0)
    for c in classes:
        sound = sound & (value(f"class_{c}_count") == per_class)
    return out.unionByName(out.agg(F.coalesce(sound, F.lit(False)).cast("long").alias("value")).select(F.lit("status").alias("name"), "value"))


def annotation_source(rows: DataFrame, image: str, label: str, box: tuple[str, str, str, str]) -> DataFrame:
    """(name, value) about a source of annotations: rows, images, boxes without area, repeated rows, and of each class its rows and images.

    Compare with ``pinned``. Boxes of which an edge is null or NaN have no area.
    """
    x0, y0, x1, y1 = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in box)
    area = F.coalesce((x1 > x0) & (y1 > y0), F.lit(False))
    whole = measures(rows, {"annotations": F.count("*"), "images": F.count_distinct(image), "invalid_boxes": F.count_if(~area)})
    classes = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("r"), F.count_distinct(image).alias("i"))
    name = lambda what: F.concat(F.lit("class_"), F.col(label).cast("string"), F.lit(f"_{what}"))
    each = classes.select(F.inline(F.array(F.struct(name("rows").alias("name"), F.col("r").alias("value")), F.struct(name("images").alias("name"), F.col("i").alias("value")))))
    return stacked([whole, _one(repeated(rows, rows.columns), "beyond_first", "repeated_rows"), each])


def against_cache(manifest: DataFrame, cache: DataFrame, index: str, provenance: tuple[str, str] | None = None) -> DataFrame:
    """(check, passed, n) of a manifest beside stored vectors: the same indices, each once on either side, none without a gap.

    n counts what is wrong: indices of one side alone, rows beyond the first of an index, gaps below the greatest one, and
    vectors whose provenance (a column and its value) is another.
    """
    sides = {"manifest": manifest, "cache": cache}
    count = lambda rows, side: rows.groupBy(F.col(index).alias("i")).agg(F.count("*").alias(side))
    met = joined(count(manifest, "manifest"), count(cache, "cache"), ["i"], "full_outer")
    found = {"only_manifest": F.count_if(F.col("cache").isNull()), "only_cache": F.count_if(F.col("manifest").isNull())}
    found |= {f"repeated_{s}": F.sum(F.col(s) - 1) for s in sides}
    found["gaps"] = F.max("i") + 1 - F.count_if(F.col("i").between(0, 2**62) & F.col("manifest").isNotNull())
    parts = [measures(met, found)]
    if provenance:
        parts.append(measures(cache, {"foreign": F.count_if(~F.col(provenance[0]).eqNullSafe(F.lit(provenance[1])))}))
    return stacked(parts).select(F.col("name").alias("check"), (F.col("value") == 0).alias("passed"), F.col("value").alias("n"))


def conjunction(checked: DataFrame) -> DataFrame:
    """(check, passed, failing) over models from (model, check, passed): passed by all, and the names of those that fail; a null fails."""
    bad = F.when(~F.coalesce("passed", F.lit(False)), F.col("model"))
    out = checked.groupBy("check").agg(F.every(F.coalesce("passed", F.lit(False))).alias("passed"), F.array_join(F.array_sort(F.collect_set(bad)), ";").alias("failing"))
    return out


def wide_models(values: DataFrame, models: list[str], marked: list) -> DataFrame:
    """(class_id, metric, a column a model, a column a difference of two, highlighted) from (model, class_id, metric, value).

    Differences are the later model's value less the earlier one's; a model without the value has a null, and so have its
    differences. ``marked`` classes are highlighted.
    """
    of = values.groupBy("class_id", "metric").agg(*(F.max(F.when(F.col("model") == m, F.col("value"))).alias(m) for m in models))
    pairs = [(a, b) for i, b in enumerate(models) for a in models[:i]]
    return of.withColumns({f"{b}_minus_{a}": F.col(b) - F.col(a) for a, b in pairs}).withColumn("highlighted", F.col("class_id").isin(marked))


def status_report(rows: DataFrame, status: str, errors: DataFrame, error: str) -> DataFrame:
    """(kind, name, n): how many rows have each status (blank for null), and how often each error was found."""
    count = lambda df, c, kind: df.groupBy(F.coalesce(F.trim(F.lower(F.col(c).cast("string"))), F.lit("")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count(rows, status, "status").unionByName(count(errors, error, "error"))


def record(parts: dict[str, DataFrame]) -> DataFrame:
    """One row, ``record``: JSON of some measures (name, value), an object for each part with its names in order."""
    each = stacked([rows.select(F.lit(part).alias("part"), "name", "value") for part, rows in parts.items()])
    held = each.groupBy("part").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("m"))
    return held.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("part", F.to_json("m").alias("j"))))).alias("m")).select(
        F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"])), ","), F.lit("}")).alias("record")
    )


def views(rows: DataFrame, named: dict[str, list[str]]) -> DataFrame:
    """(view, a column a key, n): counts of several groupings from one scan; a key that a view doesn't group by is ALL, a null key stays null."""
    keys = list(dict.fromkeys(k for own in named.values() for k in own))
    texts = rows.select(*(F.col(k).cast("string").alias(k) for k in keys))
    counted = texts.groupingSets(list(named.values()), *keys).agg(F.grouping_id().alias("_g"), *(F.grouping(k).alias(f"_g_{k}") for k in keys), F.count("*").alias("n"))
    number = {sum((k not in own) << (len(keys) - 1 - i) for i, k in enumerate(keys)): name for name, own in named.items()}
    view = F.try_element_at(F.create_map(*(F.lit(x) for kv in number.items() for x in kv)), F.col("_g").cast("int"))
    return counted.select(view.alias("view"), *(F.when(F.col(f"_g_{k}") == 1, "ALL").otherwise(F.col(k)).alias(k) for k in keys), "n")


def availability(rows: DataFrame, by: list[str], image: str, requested: int) -> DataFrame:
    """(by, available, requested, rendered): different images of a group, how many are asked for, and how many can be shown."""
    out = rows.groupBy(*by).agg(F.count_distinct(image).alias("available"))
    return out.withColumns({"requested": F.lit(requested).cast("long"), "rendered": F.least(F.col("available"), F.lit(requested).cast("long"))})


def inference_rows(rows: DataFrame, scores: str, thresholds: list[float], names: list[str]) -> DataFrame:
    """The other columns with positive_ids and positive_names (by threshold, in the classes' order, ``|`` between), n_positive, top_id and top_name.

    A class is positive where its score reaches its threshold; the top is the first greatest score. Null scores are none.
    """
    score = F.transform(scores, lambda x: F.coalesce(x.cast("double"), F.lit(float("-inf"))))
    hit = F.filter(F.transform(score, lambda x, i: F.when(x >= F.get(F.array(*map(F.lit, thresholds)), i), i)), lambda i: i.isNotNull())
    name = lambda i: F.get(F.array(*map(F.lit, names)), i)
    top = (F.array_position(score, F.array_max(score)) - 1).cast("int")
    return rows.withColumns({"positive_ids": F.array_join(F.transform(hit, lambda i: i.cast("string")), "|"), "positive_names": F.array_join(F.transform(hit, name), "|"), "n_positive": F.size(hit).cast("long"), "top_id": top, "top_name": name(top)}).drop(scores)
