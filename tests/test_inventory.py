"""Stored vectors, stems, folders, report inputs and covering samples, on small tables against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import compare, relate, samples, validate, vectors
from cairn.sources import readers

NAN = float("nan")
SHARDS = [(0, "new", [1.0, 2.0]), (1, "new", [0.0, 0.0]), (2, "new", [NAN, 1.0]), (3, None, [1.0, 1.0]), (3, "new", [1.0, 1.0]), (4, "new", [1.0]), (4, "new", None), (5, "new", [1.0, None]), (6, "new", [1.0, 1.0]), (6, "new", [2.0, 1.0]), (-1, "new", [1.0, 1.0]), (None, "new", [1.0, 1.0])]


def test_shards_and_caches(spark):
    rows = spark.createDataFrame(SHARDS, "i long, revision string, v array<double>")
    judged = vectors.shard_reason(rows, "i", "v", 8, 2, {"revision": "new"})
    got = sorted((r["i"] is None, r["i"] or 0, r["reason"]) for r in judged.collect())
    assert got == [(False, -1, "out_of_range"), (False, 0, ""), (False, 1, "zero_norm"), (False, 2, "not_finite"), (False, 3, ""), (False, 3, "provenance"), (False, 4, "bad_shape"), (False, 4, "bad_shape"), (False, 5, "not_finite"), (False, 6, "duplicate"), (False, 6, "duplicate"), (True, 0, "out_of_range")]
    wanted = spark.range(8).select(F.col("id").alias("i"))
    assert sorted(r["i"] for r in vectors.still_to_do(wanted, judged, "i").collect()) == [1, 2, 4, 5, 6, 7]
    found = vectors.cache_check(rows, "i", "v", 8, 2).first().asDict()
    assert found == {"rows": 12, "unique_indices": 8, "missing": 1, "duplicates": 3, "out_of_range": 2, "bad_shape": 2, "not_finite": 2, "zero_norm": 1, "status": "FAIL"}
    assert vectors.cache_check(rows.where("i = 0"), "i", "v", 1, 2).first()["status"] == "PASS"
    assert vectors.cache_check(rows.where("i = 99"), "i", "v", 2, 2).first()["missing"] == 2


def test_covering_sample_equals_the_plain_choice(spark):
    r = random.Random(3)
    rows = [(i, sorted(r.sample(range(4), r.choice((1, 1, 1, 2, 2, 3))))) for i in range(200)]
    got = {x["id"]: (x["pick"], x["reason"]) for x in samples.covering(spark.createDataFrame(rows, "id int, kinds array<int>"), "kinds", "id", 20, 4, least=6).collect()}
    left, covered, want = {1: 7, 2: 7, 3: 6}, [0] * 4, {}
    for pick in range(1, 21):
        def worth(row):
            lack = [max(0, 6 - covered[c]) for c in row[1]]
            return -sum(lack), -sum(x > 0 for x in lack), -left[len(row[1])], sum(covered[c] for c in row[1]), hashlib.sha256(f"42:{row[0]}".encode()).hexdigest()

        best = min((row for row in rows if row[0] not in want and left[len(row[1])]), key=worth)
        want[best[0]] = pick, "-".join(str(c) for c in best[1] if covered[c] < 6) or "balanced"
        left[len(best[1])] -= 1
        for c in best[1]:
            covered[c] += 1
    assert got == want
    with pytest.raises(ValueError):
        samples.covering(spark.createDataFrame(rows[:5], "id int, kinds array<int>"), "kinds", "id", 20, 4)
    with pytest.raises(ValueError):
        samples.covering(spark.createDataFrame([], "id int, kinds array<int>"), "kinds", "id", 20, 4)


def test_stems_and_class_folders(spark, tmp_path):
    for folder, name, content in (("class1", "a_class1_bbox0001.png", b"x"), ("class1", "b_class2_bbox0001.png", b"x"), ("class2", "b_class2_bbox0002.PNG", b""), ("class2", "odd.png", b"x"), ("class2", "b_class2_bbox0003.txt", b"x")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(content)
    files = readers.class_folders(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in files.collect()}
    assert got == {"a_class1_bbox0001.png": "", "b_class2_bbox0001.png": "class", "odd.png": "name", "b_class2_bbox0003.txt": "suffix"}
    paths = spark.createDataFrame([("x/a.png",), ("y/a.jpg",), ("y/b.png",), ("c",)], "path string")
    assert {r["stem"]: (r["copies"], r["paths"]) for r in readers.stems(paths).collect()} == {"a": (2, ["x/a.png", "y/a.jpg"]), "b": (1, None), "c": (1, None)}


def test_reasons_of_reports_and_lists(spark):
    rows = [([0.5, 0.1], [0.5, 0.5], [0], ["x"], ""), ([0.5], [0.5, 0.5], [0], ["x"], "length"), ([0.5, 1.1], [0.5, 0.5], [0], ["x"], "out_of_range"), ([0.5, 0.1], [0.5, 0.5], [1, 0], ["y", "x"], "unsorted"), ([0.5, 0.1], [0.5, 0.5], [0], ["y"], "names"), ([0.5, 0.1], [0.5, 0.5], [0, 0], ["x", "x"], "repeated"), (None, [0.5, 0.5], [0], ["x"], "length"), ([0.5, 0.1], [0.5, 0.5], [], [], ""), ([0.5, 0.1], [0.5, 0.5], [2], ["z"], "out_of_range")]
    df = spark.createDataFrame(rows, "p array<double>, t array<double>, ids array<int>, names array<string>, want string")
    for r in df.withColumn("got", validate.report_reason(F.col("p"), F.col("t"), F.col("ids"), F.col("names"), ["x", "y"])).collect():
        assert r["got"] == r["want"], r
    kinds = spark.createDataFrame([([1, 2], [2, 1]), ([1], [1, 2]), ([1], [2]), ([], []), (None, [1])], "a array<int>, b array<int>")
    assert [r[0] for r in kinds.select(compare.match_kind(F.col("a"), F.col("b"))).collect()] == ["exact", "partial", "miss", "exact", None]


def test_corrections_and_matrices(spark):
    before = spark.createDataFrame([(1, None), (2, 5), (3, 6), (4, 1)], "k int, v int")
    after = spark.createDataFrame([(1, None), (2, None), (3, 7), (9, 1)], "k int, v int")
    assert tuple(relate.corrections(before, after, ["k"], "v").first()) == (3, 2)
    cells = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 1, 2)], "truth int, predicted int, n long")
    wide = compare.matrix_rows(cells, [0, 1])
    assert sorted(map(tuple, wide.collect())) == [(0, 3, 1), (1, 0, 2)]
    assert sorted(map(tuple, compare.matrix_cells(wide, "truth").collect())) == [(0, 0, 3), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
