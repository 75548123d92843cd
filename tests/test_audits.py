"""Annotations, reviews and audits of sets on small tables with nulls, blanks, ties and repeated rows, and on empty ones."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.operators import annotations, audits, relate, reviews
from cairn.plans import catalogue

NAN = float("nan")
ROWS = "i long, image string, class_id string, class_name string, x0 string, y0 string, x1 string, y1 string, split string"


def boxes(*rows):
    return [(i, image, c, name, *(str(e) if e is not None else None for e in box), "train") for i, image, c, name, box in rows]


def test_annotations_get_the_first_verdict(spark):
    rows = spark.createDataFrame(
        boxes(
            (1, "a", "0", "", (1, 1, 5, 5)),
            (2, "a", "0", "own", (1, 1, 6, 6)),  # an earlier row has the key
            (3, "gone", "0", None, (1, 1, 5, 5)),
            (4, "gone", "0", None, (1, 1, 5, 5)),  # a duplicate of a missing image is a duplicate
            (5, "broken", "1", None, (1, 1, 5, 5)),
            (6, "a", "1", None, (-3, 1, 50, 5)),
            (7, "a", "2.0", None, (5, 5, 5, 9)),  # no whole number as it is written
            (8, "b", "7", None, ("x", 1, 2, 3)),
            (9, None, "1", None, (1, 1, 5, 5)),
            (10, None, "1", None, (1, 1, 5, 5)),
            (11, "b", "1", None, (90, 1, 95, 3)),
        ),
        ROWS,
    )
    names = spark.createDataFrame([(0, "zero"), (1, "one"), (2, "two")], "class_id int, name string")
    plain = annotations.normalise(rows, names)
    told = {r["i"]: (r["class_id"], r["class_name"]) for r in plain.collect()}
    assert told[1] == (0, "zero") and told[2] == (0, "own") and told[7] == (None, None) and told[8] == (7, None)
    images = spark.createDataFrame([("a", 20, 10, None), ("b", 20, 10, ""), ("broken", 20, 10, "cut off"), ("b", 20, 10, "")], "image string, width int, height int, error string")
    done = annotations.audit(plain, images, ["image", "class_id"], "image", "i")
    got = {r["i"]: (r["reason"], r["needs_clamp"]) for r in done.collect()}
    assert got == {1: ("", False), 2: ("duplicate_annotation", False), 3: ("missing_image", False), 4: ("duplicate_annotation", False), 5: ("image_read_error", False), 6: ("", True), 7: ("non_positive_bbox_area", False), 8: ("non_finite_bbox", False), 9: ("missing_image", False), 10: ("duplicate_annotation", False), 11: ("bbox_completely_outside_image", True)}
    assert {k: sorted(r["i"] for r in v.collect()) for k, v in annotations.routed(done).items()} == {"valid": [1, 6], "clamped": [6], "duplicate": [2, 4, 10], "missing": [3, 9], "unreadable": [5], "invalid": [7, 8, 11]}
    counts = {(r["split"], r["class_id"]): tuple(r)[2:] for r in annotations.class_counts(done, "image", ["train", "val"], [0, 1]).collect()}
    assert counts == {("train", 0): (4, 1, 2, 1, 0, 1), ("train", 1): (5, 1, 1, 1, 2, 1), ("val", 0): (0,) * 6, ("val", 1): (0,) * 6}
    by_image = {r["image"]: r for r in annotations.image_counts(done, "image").collect()}
    assert (by_image["a"]["classes"], by_image["a"]["annotations"], by_image["a"]["single"]) == ([0, 1], 4, False) and by_image[None]["classes"] == []
    assert annotations.audit(plain.limit(0), images, ["image", "class_id"], "image", "i").count() == 0
    manifest = spark.createDataFrame([("a", "p"), ("b", "q"), ("b", "o"), (None, "z")], "image string, path string")
    met = {r["i"]: (r["path"], r["in_manifest"]) for r in annotations.with_manifest(plain, manifest, "image", ["path"]).collect()}
    assert met[1] == ("p", "yes") and met[8] == ("o", "several") and met[3] == met[9] == (None, "no") and len(met) == 11


def review(row, path, status="pass", index="1", **more):
    given = {"crop_path": path, "source_image_id": "s", "split": "train", "class_id": "0", "class_name": "n", "annotation_index": index, "review_status": status, "technical_issue": "none", "review_note": None} | more
    return (row, *(given[c] for c in reviews.REQUIRED))


def test_reviews(spark):
    schema = "row long, " + ", ".join(f"{c} string" for c in reviews.REQUIRED)
    rows = spark.createDataFrame(
        [review(2, "x\\a_bbox1.png"), review(3, "x/a_bbox1.png", " FAIL "), review(4, "x/b_bbox0002.PNG", "maybe", "2"), review(5, "c.png", class_name=" "), review(6, "d_bbox3.png", index="3.5"), review(7, "e_bbox9.png", index="8"), review(8, None, None, None, split=""), review(9, "f_bbox1.png", source_image_id="t")],
        schema,
    )
    got = {}
    for r in reviews.review_errors(rows, "row").collect():
        got.setdefault(r["row"], []).append(r["error"])
    assert {k: sorted(v) for k, v in got.items()} == {
        2: ["duplicate_annotation_index", "duplicate_crop_path"],
        3: ["duplicate_annotation_index", "duplicate_crop_path"],
        4: ["invalid_review_status"],
        5: ["duplicate_annotation_index", "missing_bbox_index_in_filename", "missing_class_name"],
        6: ["invalid_annotation_index"],
        7: ["annotation_index_filename_mismatch"],
        8: ["missing_annotation_index", "missing_bbox_index_in_filename", "missing_crop_path", "missing_review_status", "missing_split"],
    }
    told = reviews.summary(rows, reviews.review_errors(rows, "row")).first()
    assert (told["rows"], told["rows_with_errors"], told["errors"], told["status"]) == (8, 7, 15, "FAIL") and told["kinds"]["duplicate_crop_path"] == 2
    clean = rows.where("row = 9")
    assert reviews.summary(clean, reviews.review_errors(clean, "row")).first()["status"] == "PASS"
    assert [tuple(r) for r in reviews.review_errors(rows.drop("split", "class_id"), "row").collect()] == [(None, "missing_required_column", "split;class_id")]
    manifest = spark.createDataFrame([("x/a_bbox1.png", "s", "train", "0", "n", "1"), ("e_bbox9.png", "s", "val", "0", "n", "8"), ("d_bbox3.png", "s", "train", "0", "n", "3"), ("d_bbox3.png", "s", "train", "0", "n", "3")], "crop_path string, source_image_id string, split string, class_id string, class_name string, annotation_index string")
    found = {}
    for r in reviews.against_manifest(rows.where("row IN (2, 4, 6, 7)"), manifest, "row").collect():
        found.setdefault(r["row"], {})[r["error"]] = r["detail"]
    assert found == {4: {"crop_path_missing_from_manifest": "x/b_bbox0002.PNG"}, 6: {"ambiguous_manifest_path": "2", "annotation_index_filename_mismatch": "3"}, 7: {"manifest_field_mismatch": "split", "annotation_index_filename_mismatch": "8 and 9"}}
    crops = {r["crop_path"]: (r["manual_review_status"], r["include_for_model"], r["exclusion_reason"]) for r in reviews.with_reviews(manifest.select("crop_path").distinct(), rows).collect()}
    assert crops == {"x/a_bbox1.png": ("fail", False, "manual_review_fail"), "e_bbox9.png": ("pass", True, ""), "d_bbox3.png": ("pass", True, "")}
    assert reviews.with_reviews(manifest, rows.limit(0)).where("manual_review_status = 'not_sampled' AND include_for_model").count() == 4


def test_members_instead_of_pairs_and_lists(spark):
    rows = spark.createDataFrame([(1, 1, "A"), (1, 2, None), (1, 3, "A"), (2, 1, "B"), (2, 2, "B"), (None, 1, "x"), (None, 2, "y")], "k long, i long, v string")
    got = {(r["k"], r["i"]): (r["values"], r["others"]) for r in relate.conflict_members(rows, ["k"], ["v"]).collect()}
    pairs = {}
    for r in relate.conflicts(rows.where("k IS NOT NULL"), ["k"], "i", ["v"]).collect():
        pairs[r["k"], r["left_i"]] = pairs.get((r["k"], r["left_i"]), 0) + 1
    assert {k: v[1] for k, v in got.items() if k[0] is not None} == pairs and got[None, 1] == (2, 1)
    held = spark.createDataFrame([("h", "a", "p1", "s1"), ("h", "b", "p1", "s2"), ("h", "b", "p2", None), ("g", "a", "p3", "s1"), (None, "a", "p", "s"), (None, "b", "p", "s")], "sha string, part string, path string, source string")
    members = {(r["part"], r["path"]): tuple(r)[4:] for r in relate.content_members(held, "sha", "part", "source").collect()}
    assert members == {("a", "p1"): (3, 2, 2, True, True), ("b", "p1"): (3, 2, 2, True, True), ("b", "p2"): (3, 2, 2, True, True)}
    assert [tuple(r) for r in relate.content_groups(held, "sha", "part", ["a", "b"], "path", "source", 1).collect()] == [("h", 3, 2, 1, 2, 2, "s1", True)]
    both = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, None, "b"), (4, None, None)], "i int, x string, y string")
    assert sorted(r["i"] for r in relate.discordant(both, "x", "y").collect()) == [2, 3]
    rows = spark.createDataFrame([("o", "train", True), ("o", "val", False), ("p", "train", False), ("p", "test", False), ("q", "train", True), (None, "train", True), (None, "val", False)], "o string, split string, augmented boolean")
    assert [tuple(r) for r in relate.augmentation_leak(rows, "o", "augmented").collect()] == [("o", 1, 1)]


def test_audits_of_sets(spark):
    m = audits.measures(spark.range(3), {"rows": F.count("*"), "none": F.max(F.lit(None).cast("int"))})
    assert {tuple(r) for r in audits.pinned(m, {"rows": 3, "none": 1, "absent": 0}).collect()} == {("rows", 3, 3, True), ("none", 1, 0, False), ("absent", 0, None, False)}
    images = spark.createDataFrame([("a", "h", None), ("b", "h", ""), ("c", "g", "cut"), ("c", "g", "cut"), ("d", None, None)], "image_id string, sha256 string, error string")
    told = spark.createDataFrame([(" a", "0", "x"), ("a ", "0", "x"), ("e", "1", "y"), ("b", "1", "x"), (None, "0", "x"), ("b", "z", "x")], "image_id string, class_id string, class_name string")
    got = {r["name"]: r["value"] for r in audits.catalogue(images, told, {0: "x", 1: "y"}).collect()}
    assert got == {"raw_image_count": 5, "annotation_rows": 6, "invalid_label_count": 3, "unique_annotation_image_id_count": 2, "manifest_rows": 3, "missing_image_count": 1, "image_without_annotation_count": 3, "unreadable_image_count": 1, "duplicate_image_id_count": 1, "duplicate_sha256_group_count": 1, "duplicate_annotation_row_count": 1}
    schema = "path string, file_name string, class_id int, source_image_id string, original_roi_id string, augmented boolean, feature_index long, size long, error string, sha256 string"
    good = [(f"p{i}", f"n{i}", i % 2, "s", "r", i > 2, i, 9, None, f"h{i // 2}") for i in range(4)]
    known = spark.createDataFrame([("s",)], "source_image_id string")
    status = lambda rows: {r["name"]: r["value"] for r in audits.balanced_set(spark.createDataFrame(rows, schema), known, [0, 1], 2).collect()}
    first = status(good)
    assert first["status"] == 1 and first["duplicate_sha256_group_count"] == 2 and first["duplicate_sha256_image_count"] == 4
    for column, value, name in ((0, "p0", "duplicate_path_count"), (3, "t", "source_image_id_not_in_metadata_count"), (3, " ", "missing_source_image_id_count"), (4, None, "augmented_without_source_count"), (7, 0, "zero_byte_file_count"), (8, "cut", "unreadable_image_count"), (2, 5, "invalid_class_id_count"), (2, None, "missing_class_id_count")):
        bad = [*good[:3], tuple(value if i == column else x for i, x in enumerate(good[3]))]
        assert status(bad)[name] == 1 and status(bad)["status"] == 0
    assert status([*good[:3], (*good[3][:6], 7, *good[3][7:])])["status"] == 0 and status([])["status"] == 0
    source = audits.annotation_source(spark.createDataFrame([("a", "0", 1.0, 1.0, 2.0, 2.0), ("a", "0", 1.0, 1.0, 2.0, 2.0), ("b", None, 1.0, 1.0, NAN, 2.0)], "i string, c string, x0 double, y0 double, x1 double, y1 double"), "i", "c", ("x0", "y0", "x1", "y1"))
    assert {tuple(r) for r in source.collect()} == {("annotations", 3), ("images", 2), ("invalid_boxes", 1), ("repeated_rows", 1), ("class_0_rows", 2), ("class_0_images", 1)}
    left, right = spark.createDataFrame([(0,), (1,), (1,), (4,)], "i long"), spark.createDataFrame([(0, "r"), (2, None)], "i long, v string")
    assert {r["check"]: r["n"] for r in audits.against_cache(left, right, "i", ("v", "r")).collect()} == {"only_manifest": 2, "only_cache": 1, "repeated_manifest": 1, "repeated_cache": 0, "gaps": 2, "foreign": 1}
    same = spark.range(5).select(F.col("id").alias("i"))
    assert all(r["passed"] for r in audits.against_cache(same, same, "i").collect())


def test_reports(spark):
    checked = spark.createDataFrame([("a", "x", True), ("b", "x", False), ("a", "y", True), ("b", "y", True), ("a", "z", None)], "model string, check string, passed boolean")
    assert {tuple(r) for r in audits.conjunction(checked).collect()} == {("x", False, "b"), ("y", True, ""), ("z", False, "a")}
    values = spark.createDataFrame([("a", 0, "f1", 0.5), ("b", 0, "f1", 0.75), ("a", 1, "f1", 0.5)], "model string, class_id int, metric string, value double")
    assert {tuple(r) for r in audits.wide_models(values, ["a", "b"], [1]).collect()} == {(0, "f1", 0.5, 0.75, 0.25, False), (1, "f1", 0.5, None, None, True)}
    one = spark.createDataFrame([("n", 1), ("m", 2)], "name string, value long")
    assert json.loads(audits.record({"b": one, "a": one.where("value = 1")}).first()["record"]) == {"a": {"n": 1}, "b": {"m": 2, "n": 1}}
    rows = spark.createDataFrame([(" Pass",), ("pass",), (None,)], "s string")
    assert {tuple(r) for r in audits.status_report(rows, "s", rows.where("s = 'pass'"), "s").collect()} == {("status", "pass", 2), ("status", "", 1), ("error", "pass", 1)}
    shown = spark.createDataFrame([(None, 1), ("g", 1), ("g", 1), ("g", 2), ("g", 3)], "g string, i int")
    assert {tuple(r) for r in audits.availability(shown, ["g"], "i", 2).collect()} == {(None, 1, 2, 1), ("g", 3, 2, 2)}
    scores = spark.createDataFrame([(1, [0.5, 0.5, 0.1]), (2, [0.0, None, 0.0])], "i int, p array<double>")
    got = {r["i"]: tuple(r)[1:] for r in audits.inference_rows(scores, "p", [0.5, 0.4, 0.2], ["x", "y", "z"]).collect()}
    assert got == {1: ("0|1", "x|y", 2, 0, "x"), 2: ("", "", 0, 0, "x")}


COPIED = ["annotation_audit", "annotation_class_counts", "annotation_images", "annotation_routes"]


@pytest.mark.parametrize("name", COPIED)
def test_of_lines_equal_in_everything_one_stands(spark, tmp_path, name):
    lines = [(o, n, q, p, 0.05, f) for o in range(1, 9) for n, q, p, f in [(1, 20.0, 1015.0, "A"), (1, 20.0, 1015.0, "A"), (1, 20.0, 1015.0, "A"), (2, 21.0, 1015.0, "A"), (3, 20.0, 1000.0, "N"), (3, 20.0, 1000.0, "N")]]
    orders = [(o, "P" if o == 2 else "O", "4-NOT SPECIFIED" if o == 3 else "5-LOW") for o in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
