"""Pairing, comparisons, validators, samples and splits on small tables with nulls, ties and repeated rows."""

from math import comb

import pytest
from pyspark.sql import functions as F

from cairn.operators import compare, metrics, relate, splits, validate, vectors


def test_exact_tail(spark):
    pairs = [(0, 0), (1, 0), (5, 3), (40, 60), (125, 89), (3, 900)]
    got = {(r["b"], r["c"]): r["p"] for r in spark.createDataFrame(pairs, "b long, c long").withColumn("p", metrics.exact_tail(F.col("b"), F.col("c"))).collect()}
    for b, c in pairs:
        n = b + c
        want = min(1.0, 2 * sum(comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0
        assert got[b, c] == pytest.approx(want, rel=1e-9)


def test_conflicts_see_nulls(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, "A"), (2, 1, "B"), (2, 2, "B")], "k long, i long, v string")
    assert {(r["left_i"], r["right_i"]) for r in relate.conflicts(rows, ["k"], "i", ["v"]).collect()} == {(1, 2), (2, 1)}


def test_mismatches_keep_rows_without_counterpart(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, v string")
    b = spark.createDataFrame([(1, "z"), (3, None)], "k long, v string")
    assert {(r["k"], r["fields"]) for r in relate.mismatches(a, b, "k", ["v"]).collect()} == {(1, "v"), (2, "missing")}


def test_numbered_counts_within_keys(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else i % 3, i) for i in range(50)], "k long, i long").repartition(4)
    found = {}
    for r in relate.numbered(rows, ["k"], ["i"], "place").collect():
        found.setdefault(r["k"], []).append((r["i"], r["place"]))
    assert all([p for _, p in sorted(x)] == list(range(len(x))) for x in found.values()) and len(found) == 3


def test_fallback_and_unpaired(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (None, "zz"), (9, "a"), (9, None), (3, "c"), (8, "d")], "i long, path string")
    manifest = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, None, 15), (3, "c", 30), (3, "e", 31), (5, "d", 40), (6, "d", 41)], "i long, path string, v long")
    got = {(r["i"], r["path"]): (r["v"], r["matched_by"]) for r in relate.by_fallback(rows, manifest, "i", ["path"], ["v"]).collect()}
    assert got == {(1, "a"): (10, "index"), (None, "b"): (20, "fallback"), (None, "zz"): (None, "none"), (9, "a"): (10, "fallback"), (9, None): (None, "none"), (3, "c"): (None, "ambiguous"), (8, "d"): (None, "ambiguous")}
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k long"), spark.createDataFrame([(1,), (2,)], "k long")
    assert [tuple(r) for r in relate.unpaired({"a": a, "b": b}, ["k"]).collect()] == [(2, 2, 1)]


def test_guarded_membership(spark):
    a, none = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([], "k long")
    assert relate.absent_if_any(a, none, "k").count() == 0
    assert [r["k"] for r in relate.absent_if_any(a, a.where("k = 1"), "k").collect()] == [2]


def test_probabilities_and_rules(spark):
    rows = [([0.5, 0.5],), ([0.5, 0.4],), ([1.5, -0.5],), ([float("nan"), 1.0],), ([],), (None,)]
    got = [r["x"] for r in spark.createDataFrame(rows, "p array<double>").select(validate.probability_reason(F.col("p")).alias("x")).collect()]
    assert got == ["", "bad_sum", "out_of_range", "not_finite", "empty", "empty"]


def test_conclusion_and_gate(spark):
    rows = spark.createDataFrame([(0.1, 0.3, 0.2), (-0.3, -0.1, -0.2), (-0.1, 0.2, 0.1), (-0.2, 0.1, -0.1), (-0.1, 0.1, 0.0)], "low double, high double, gain double")
    got = [r["x"] for r in rows.select(compare.conclusion(F.col("low"), F.col("high"), F.col("gain")).alias("x")).collect()]
    assert got == ["supported_gain", "supported_loss", "inconclusive_gain", "inconclusive_loss", "equal"]
    checked = compare.checks(rows, {"some": F.count("*") > 0, "low": F.min("low") > 0, "none": F.lit(None).cast("boolean")})
    assert tuple(compare.gate(checked).first()) == (3, 2, "low;none", "FAIL")


def test_vectors_of_odd_numbers(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0])], "k long, v array<double>")
    got = {(r["k"], r["overall"]): r for r in vectors.statistics(rows, "v", "k").collect()}
    assert got[1, False]["zero_norm"] == 1 and got[1, False]["max_norm"] == 5.0 and got[2, False]["not_finite"] == 1
    assert got[None, True]["vectors"] == 3


def test_greedy_split_meets_targets(spark):
    groups = spark.createDataFrame([(i, ["a", "b"] if i % 4 == 0 else ["a"] if i % 2 else []) for i in range(100)], "id long, labels array<string>")
    got = splits.grouped_split(groups)
    counts = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert got.select("id").distinct().count() == 100 and sum(counts.values()) == 100
    assert abs(counts["train"] - 80) <= 2 and abs(counts["val"] - 10) <= 2
    again = {r["id"]: r["split"] for r in splits.grouped_split(groups.repartition(7)).collect()}
    assert again == {r["id"]: r["split"] for r in got.collect()}
