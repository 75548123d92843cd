"""Predictions, splits, thresholds, master tables and image headers with planted faults."""

import json
import math
import struct

from pyspark.sql import functions as F

from cairn.functions import cols
from cairn.operators import compare, folders, history, integrity, samples, splits
from cairn.sources import files, readers

NAMES = {0: "x", 1: "y", 2: "z"}


def prediction(k, true=0, called=0, p=(0.6, 0.3, 0.1), confidence=0.6, right=None, true_name=None, called_name=None):
    return (k, true, true_name or NAMES.get(true), called, called_name or NAMES.get(called), None if p is None else list(p), confidence, (true == called) if right is None else right)


def test_prediction_errors(spark):
    rows = [prediction(1), prediction(2, called=1), prediction(3, true=9), prediction(4, true_name="y"), prediction(5, p=(0.6, 0.3)), prediction(6, p=(math.nan, 0.3, 0.1)), prediction(7, p=None), prediction(8, confidence=0.5), prediction(9, right=False), prediction(10, p=(0.5, 0.5), confidence=0.5), prediction(11), prediction(11), prediction(12, p=(0.4, 0.4, 0.2), confidence=0.4), prediction(13, confidence=None)]
    df = spark.createDataFrame(rows, "k long, true_class_id int, true_class_name string, predicted_class_id int, predicted_class_name string, probabilities array<double>, confidence double, is_correct boolean")
    got = {}
    for r in integrity.prediction_errors(df, "k", NAMES).collect():
        got.setdefault(r["k"], []).append(r["error"])
    assert {k: sorted(v) for k, v in got.items()} == {2: ["not_the_top"], 3: ["invalid_class"], 4: ["class_name_mismatch"], 5: ["bad_sum"], 6: ["not_finite"], 7: ["empty"], 8: ["confidence_mismatch"], 9: ["correctness_mismatch"], 10: ["wrong_length"], 11: ["duplicate_key"] * 2, 13: ["confidence_mismatch"]}


def test_split_integrity(spark):
    rows = [(1, "h1", "train", True), (2, "h2", "train", False), (3, "h3", "val", True), (4, "h1", "val", True), (4, None, "test", False), (5, None, None, True), (6, "h1", "test", True)]
    checks = integrity.split_integrity(spark.createDataFrame(rows, "i long, sha string, split string, long boolean"), {"train": 2, "val": 1, "test": 2}, ["i"], ["sha"], {"long": F.col("long")})
    assert {r["check"]: (r["passed"], r["n"]) for r in checks.collect()} == {"master_rows": (False, 7), "train_rows": (True, 2), "val_rows": (False, 2), "test_rows": (True, 2), "unknown_split": (False, 1), "train_long_positive": (True, 1), "train_long_negative": (True, 1), "val_long_positive": (True, 2), "val_long_negative": (False, 0), "test_long_positive": (True, 1), "test_long_negative": (True, 1), "duplicate_i": (False, 1), "train_val_sha": (False, 1), "train_test_sha": (False, 1), "val_test_sha": (False, 1)}
    assert compare.gate(checks).first()["status"] == "FAIL"
    good = spark.createDataFrame([(1, "a", "train", True), (2, "b", "train", False), (3, "c", "val", True), (4, "d", "val", False)], "i long, sha string, split string, long boolean")
    assert compare.gate(integrity.split_integrity(good, {"train": 2, "val": 2}, ["i", "sha"], ["sha"], {"long": F.col("long")})).first()["status"] == "PASS"


def test_thresholds(spark):
    good = {"source_split": "validation", "test_used": False, "thresholds": {"0": 0.5, "1": 0.25}, "per_class_audit": [{"class_id": 0, "class_name": "x", "threshold": 0.5}, {"class_id": 1, "class_name": "y", "threshold": 0.25}]}
    variants = {
        "": good, "no_json": None, "not_validation": good | {"test_used": True}, "no_thresholds": {k: v for k, v in good.items() if k != "thresholds"}, "wrong_keys": good | {"thresholds": {"0": 0.5, "2": 0.1}},
        "out_of_range": good | {"thresholds": {"0": 0.5, "1": 1.5}}, "no_audit": good | {"per_class_audit": good["per_class_audit"][:1]}, "audit_mismatch": good | {"per_class_audit": [good["per_class_audit"][0], {"class_id": 1, "class_name": "z", "threshold": 0.25}]},
    }
    rows = [(want, "{" if payload is None else json.dumps(payload)) for want, payload in variants.items()]
    got = spark.createDataFrame(rows, "want string, j string").select("want", integrity.threshold_reason(F.col("j"), ["x", "y"]).alias("reason")).collect()
    assert all(r["want"] == r["reason"] for r in got)


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", width, height) + b"\x08\x00"


def test_image_headers(spark, tmp_path):
    held = {"a/ok.png": png(224, 224), "a/big.png": png(70000, 224), "a/cut.png": png(224, 224)[:20], "a/text.png": b"not a picture at all, really", "a/none.png": b""}
    for name, data in held.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = [("a\\OK.png", "success"), ("a/big.png", " Success"), ("a/cut.png", "failed"), ("a/text.png", "success"), ("a/none.png", None), ("a/gone.png", "success"), ("a/gone.png", "success")]
    found = folders.image_faults(spark.createDataFrame(rows, "p string, s string"), files.file_tree(spark, str(tmp_path), head=24), "p", 224, 224, "s")
    assert {tuple(r) for r in found.collect()} == {("a/big.png", "wrong_size", "70000x224"), ("a/cut.png", "unreadable_image", ""), ("a/text.png", "unreadable_image", ""), ("a/none.png", "empty_image", ""), ("a/gone.png", "missing_image", ""), ("a/gone.png", "duplicate_output_path", "2"), ("a/cut.png", "failed_status", "failed"), ("a/none.png", "failed_status", "")}


def test_master_and_source_manifest(spark):
    manifest = spark.createDataFrame([("c1", "o1", "success"), ("c2", "o2", "success"), ("c3", "o3", "failed"), (None, None, "success")], "source_crop_path string, output_path string, conversion_status string")
    final = spark.createDataFrame([("c1", "pass", True), ("c2", "fail", False), ("c3", "", True), ("c3", "pass", True)], "source_crop_path string, manual_review_status string, include boolean")
    manual = spark.createDataFrame([("o1", "pass")], "output_path string, review_status string")
    got = {r["source_crop_path"]: tuple(r)[3:] for r in integrity.master(manifest, final, manual).collect()}
    assert got == {"c1": ("pass", "pass", True, ""), "c2": ("", "not_sampled", False, "missing_from_final"), "c3": ("pass", "not_sampled", True, "conversion_not_success"), None: ("", "not_sampled", False, "missing_from_final")}
    rows = spark.createDataFrame([("s", 1), ("s", None), ("t", 0), (None, 1)], "s string, label int")
    made = splits.source_manifest(rows, spark.createDataFrame([("s", "train")], "s string, split string"), "s", "label", [0, 1], 42)
    assert {tuple(r) for r in made.collect()} == {("s", "train", 0, 1, 42), ("t", None, 1, 0, 42)}


def test_small_parts(spark, tmp_path):
    runs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 9)], "run string, step long")
    starts = spark.createDataFrame([("a", 3), ("a", 2)], "run string, start long")
    assert sorted(tuple(r) for r in history.resumed(runs, starts, ["run"], "step").collect()) == [("a", 1), ("b", 9)]
    assert samples.first_where(runs, F.col("step") > 1, ["step"]).first()["step"] == 2 and samples.first_where(runs, F.lit(False), ["step"]).count() == 0
    texts = spark.createDataFrame([(" a\t\n b  c ",), ("x" * 12,), ("abcde  fghij",), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(cols.collapsed(F.col("t"), 9)).collect()] == ["a b c", "xxxxxx...", "abcde...", None, ""]
    assert spark.range(1).select(cols.folded(F.lit("STRAßE")) == cols.folded(F.lit("Strasse"))).first()[0]
    assert spark.range(1).select(cols.with_prefix(F.lit("a\\raw/x"), "raw/", "new/")).first()[0] == "a/new/x"
    (tmp_path / "a.csv").write_text("id,n\n 1 ,x\n2,y\n,z\n")
    (tmp_path / "b.csv").write_text("other\n7\n")
    assert sorted(r["id"] for r in readers.id_set(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "none.csv")], "id").collect()) == ["1", "2"]


def test_manifests_and_galleries(spark):
    rows = spark.createDataFrame([(0, "a", "p", "x"), (1, "a", "p", "x"), (1, "b", " ", "y"), (4, None, None, "x"), (None, "c", "q", "x")], "i long, class_id string, path string, other string")
    got = {r["check"]: (r["passed"], r["n"]) for r in integrity.manifest_checks(rows, "i", ["path", "other"], ["path"], {"a": 2, "b": 2}).collect()}
    assert got == {"index_null": (False, 1), "blank_path": (False, 2), "blank_other": (True, 0), "class_a_rows": (True, 2), "class_b_rows": (False, 1), "other_classes": (False, 2), "index_repeated": (False, 1), "index_gaps": (False, 2), "duplicate_path": (False, 1)}
    nothing = {r["check"]: r["passed"] for r in integrity.manifest_checks(rows.limit(0), "i", ["path"], ["path"], {"a": 1}).collect()}
    assert nothing == {"index_null": True, "blank_path": True, "class_a_rows": False, "other_classes": True, "index_repeated": True, "index_gaps": True, "duplicate_path": True}
    held = spark.createDataFrame([("train", "s", 1), ("train", "s", 2), ("train", "t", None), ("val", "s", 1), ("test", None, 1)], "split string, source string, label int")
    assert {r["split"]: tuple(r)[1:] for r in splits.report(held, "source", "label").collect()} == {"train": (3, 2, {"": 1, "1": 1, "2": 1}, 1), "val": (1, 1, {"1": 1}, 1), "test": (1, 0, {"1": 1}, 0)}
    picked = spark.createDataFrame([(1, 2), (3, 1), (3, 1)], "i long, pick int")
    shown = samples.gallery(spark.createDataFrame([(1, "g"), (2, "g"), (3, "g"), (4, None)], "i long, g string"), picked, ["g"], "i")
    assert {tuple(r) for r in shown.collect()} == {("g", 3, 2, 1), (None, 1, 0, None)}


def test_scans_of_class_folders(spark, tmp_path):
    name = "i1_class0_bbox0001"
    held = {f"class0/{name}.png": png(9, 9), f"class0/{name}__aug_brightness_0001_f097.png": png(9, 9), "class0/i2_class0_bbox0002__aug_brightness_0001_f097.png": png(9, 9), "class1/i3_class0_bbox0003.png": png(9, 9), "class1/i4_class1_bbox0004.png": png(9, 8), "class1/i5_class1_bbox0005.png": b"none", "class1/other.png": png(9, 9), "class1/i6_class1_bbox0006.txt": b"x", "class1/i7_class1_bbox0007.png": b""}
    for at, data in held.items():
        (tmp_path / at).parent.mkdir(exist_ok=True)
        (tmp_path / at).write_bytes(data)
    short = lambda r: r["path"].rsplit("/", 1)[1][:2] + ("+" if r["augmented"] else "")
    got = {short(r): (r["reason"], r["feature_index"]) for r in readers.balanced_scan(spark, str(tmp_path), 9, 9).collect()}
    assert got == {"i1": ("", 0), "i1+": ("", 1), "i2+": ("original", None), "i3": ("class", None), "i4": ("wrong_size", None), "i5": ("unreadable", None), "ot": ("name", None), "i6": ("suffix", None)}
    listed = {short(r): r["reason"] for r in readers.class_folders(spark, str(tmp_path), files=files.file_tree(spark, str(tmp_path))).collect()}
    assert listed == {"i1": "", "i1+": "", "i2+": "", "i3": "class", "i4": "", "i5": "", "ot": "name", "i6": "suffix", "i7": "empty"}
    one = spark.createDataFrame([("2024-01-31T23:59:59.5Z",), ("2024-01-31",), ("2024-01-31 10:30",), ("never",), (None,)], "t string").select(cols.moment(F.col("t")).alias("m"))
    assert [r[0] for r in one.select(cols.slug(F.col("m"))).collect()] == ["20240131_235959", "20240131_000000", "20240131_103000", None, None]
