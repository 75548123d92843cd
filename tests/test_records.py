"""Documents of settings, folders and encodings, merged moments, counters, digests and run progress, against plain versions."""

import hashlib
import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cairn.operators import compare, configs, counters, digests, folders, moments
from cairn.sources import files, readers, writers
from cairn.streaming import epochs


def flat(x, path="$"):
    if isinstance(x, dict) and x:
        for k, v in x.items():
            plain = k.isascii() and k.isidentifier()
            yield from flat(v, f"{path}.{k}" if plain else path + "['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']")
    elif isinstance(x, list) and x:
        for i, v in enumerate(x):
            yield from flat(v, f"{path}[{i}]")
    else:
        yield path, json.dumps(x, separators=(",", ":"))


DOC = {"a": {"b": [1, 2, {"c": "1"}], "d e": None, "it's": {}}, "x": [], "deep": [[[[[True]]]]], "s": "{not an object}"}


def test_flatten_and_differences(spark):
    rows = spark.createDataFrame([(1, json.dumps(DOC)), (2, "no json"), (3, None), (4, "{}")], "k int, j string")
    got = sorted((r["k"], r["path"], r["value"]) for r in configs.flatten_json(rows, ["k"], "j").collect() if r["k"] == 1)
    assert got == sorted((1, p, v) for p, v in flat(DOC))
    rest = {(r["k"], r["path"], r["value"]) for r in configs.flatten_json(rows.where("k > 1"), ["k"], "j").collect()}
    assert rest == {(2, "$", None), (3, "$", None), (4, "$", "{}")}
    other = json.loads(json.dumps(DOC))
    other["a"]["b"][2]["c"] = 1
    other["x"].append(0)
    second = spark.createDataFrame([(1, json.dumps(other)), (2, "no json"), (4, "{ }"), (5, "7"), (5, "8"), (5, "8")], "k int, j string")
    found = {(r["k"], r["path"]): (r["first"], r["second"], r["change"]) for r in configs.differences(rows, second, ["k"], "j").collect()}
    assert found[1, "$.a.b[2].c"] == ('"1"', "1", "changed")
    assert found[1, "$.x"][2] == "only_first" and found[1, "$.x[0]"][2] == "only_second"
    assert found[5, "$"][2] == "ambiguous" and found[3, "$"][2] == "only_first" and len(found) == 5
    equal = {r["k"]: (r["equal"], r["different"]) for r in configs.equal_configs(rows, second, ["k"], "j").collect()}
    assert equal == {1: (False, 3), 2: (True, 0), 3: (False, 1), 4: (True, 0), 5: (False, 1)}


@pytest.fixture
def tree(tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 9
    held = {"class0/a.png": png, "class0/b.png": b"", "class0/c.png": b"not a picture", "class1/d.png": png, "train/e.png": png, "m.csv": b"\xef\xbb\xbfx\n", "n.csv": b"x\n", "late.csv.tmp": b"1"}
    for name, data in held.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(data)
    (tmp_path / "t" / "class2").mkdir()
    return str(tmp_path / "t"), held


@pytest.mark.parametrize("parts", [1, 64])
def test_files_are_listed_in_tasks(spark, tree, parts):
    root, held = tree
    rows = files.file_tree(spark, root, head=4, parts=parts).collect()
    assert {r["path"]: (r["size"], bytes(r["head"])) for r in rows if r["kind"] == "file"} == {p: (len(d), d[:4]) for p, d in held.items()}
    assert {r["path"] for r in rows if r["kind"] == "folder"} == {"class0", "class1", "class2", "train"} and len(rows) == len(held) + 4
    assert files.file_tree(spark, root + "/none").count() == 0


def test_contract_and_folder_faults(spark, tree):
    root, held = tree
    listing = files.file_tree(spark, root)
    want = spark.createDataFrame([(p,) for p in held if not p.startswith("late")] + [("gone.csv",)], "path string")
    got = {(r["path"], r["fault"]) for r in folders.contract_faults(listing, want).collect()}
    assert got == {("class0/b.png", "empty"), ("n.csv", "no_mark"), ("late.csv.tmp", "unexpected"), ("late.csv.tmp", "stray"), ("gone.csv", "missing")}
    checks = folders.contract_checks(listing, want)
    assert {r["check"]: (r["passed"], r["n"]) for r in checks.collect()} == {"no_missing": (False, 1), "no_unexpected": (False, 1), "no_empty": (False, 1), "no_stray": (False, 1), "all_marked": (False, 1), "file_count": (True, 8)}
    assert compare.gate(checks).first()["status"] == "FAIL"
    clean = listing.where("path IN ('class1/d.png', 'm.csv')")
    assert folders.contract_faults(clean, clean.select("path")).count() == 0
    manifest = spark.createDataFrame([("class0/a.png", 1), ("class0/B.png", 2), ("class0\\c.png", 2), ("class0/c.png", 3), ("class1/d.png", 4), ("class1/x.png", 5)], "path string, id int")
    got = {tuple(r) for r in folders.folder_faults(listing, manifest, ["class0", "class1", "class3"], ["train", "val"], {"class0": 4, "class1": 3, "class3": 1}, key=("id",)).collect()}
    assert got == {("class2", "unexpected_class_folder", ""), ("train", "unexpected_class_folder", ""), ("class3", "missing_class_folder", ""), ("train", "forbidden_split_folder", ""), ("class0/c.png", "duplicate_manifest_path", "2"), ("2", "duplicate_key", "2"), ("class0/b.png", "empty_file", ""), ("class0/c.png", "bad_signature", ""), ("class1/x.png", "missing_file", ""), ("class1", "class_count_mismatch", "2 of 3"), ("class3", "class_count_mismatch", "0 of 1")}


def test_encodings_are_tried_on_whole_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = {"mark.csv": "id,name\n1,é\n".encode("utf-8-sig"), "plain.csv": "id,name\n2,\"a\nb\"\n\n3\n".encode(), "big5.csv": "id,name\n4,中文\n".encode("cp950"), "none.csv": b"id\n\xff\xff\xff\n"}
    for name, data in texts.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = {(r["path"].rsplit("/", 1)[1], r["line"]): (r["encoding"], r["cells"], r["reason"]) for r in files.read_csv_any(spark, str(tmp_path / "in")).collect()}
    assert got == {("mark.csv", 1): ("utf-8-sig", {"id": "1", "name": "é"}, ""), ("plain.csv", 1): ("utf-8-sig", {"id": "2", "name": "a\nb"}, ""), ("plain.csv", 2): ("utf-8-sig", {"id": "3"}, "ragged"), ("big5.csv", 1): ("cp950", {"id": "4", "name": "中文"}, ""), ("none.csv", None): (None, None, "undecodable") if got["none.csv", None][1] is None else (None, {}, "undecodable")}
    whole = {r["path"].rsplit("/", 1)[1]: (r["encoding"], r["sha256"]) for r in files.read_texts(spark, str(tmp_path / "in"), ("nonsense", "utf-8")).collect()}
    assert whole["none.csv"][0] is None and whole["plain.csv"] == ("utf-8", hashlib.sha256(texts["plain.csv"]).hexdigest())
    want = spark.createDataFrame([("mark.csv", hashlib.sha256(texts["mark.csv"]).hexdigest()), ("plain.csv", "0"), ("gone.csv", "1"), ("big5.csv", "1"), ("big5.csv", "2")], "name string, sha256 string")
    got = {r["name"]: r["status"] for r in files.content_audit(spark, str(tmp_path / "in"), want).collect()}
    assert got == {"mark.csv": "sound", "plain.csv": "changed", "gone.csv": "missing", "big5.csv": "repeated", "none.csv": "unexpected"}


def test_small_documents_and_sets(spark, tmp_path):
    path = str(tmp_path / "x.json")
    for n in (1, 2):
        writers.write_json(spark, {"b": n, "a": "é"}, path)
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": "é", "b": 2} and not (tmp_path / "x.json.staging").exists()
    assert tuple(readers.read_json(spark, path).first()) == ("é", 2)
    one = spark.range(3)
    assert writers.write_set({"a": one, "b": one.limit(1)}, str(tmp_path / "set")) == {"a": 3, "b": 1}
    with pytest.raises(FileExistsError):
        writers.write_set({"a": one}, str(tmp_path / "set"))
    with pytest.raises(Exception):
        writers.write_set({"a": one, "b": one.select(F.raise_error(F.lit("x")).alias("y"))}, str(tmp_path / "other"))
    assert not (tmp_path / "other").exists() and not (tmp_path / "other.staging").exists()


def test_moments_merge(spark):
    r = random.Random(3)
    rows = [(r.choice((None, "a", "b")), r.randrange(4), 1e6 + r.random()) for _ in range(200)] + [("a", 0, math.nan), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = {x["g"]: x for x in moments.merge(moments.of(df, ["g", "k"], "v"), ["g"]).collect()}
    for g in (None, "a", "b"):
        own = [v for a, _, v in rows if a == g and v is not None and not math.isnan(v)]
        assert got[g]["n"] == len(own) and (got[g]["mean"], got[g]["low"], got[g]["high"]) == pytest.approx((statistics.fmean(own), min(own), max(own)))
        assert got[g]["m2"] == pytest.approx(statistics.pvariance(own) * len(own), rel=1e-6)
    assert (got["c"]["n"], got["c"]["mean"]) == (0, None)


def test_odd_patches(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 2.0], [1.0, 0.0, 2.0]), (2, [math.nan, 1.0, 0.0], [1.0, 1.0, 0.0]), (3, [1.0], [1.0, 1.0, 1.0]), (4, [], [])], "k int, a array<double>, b array<double>")
    got = {(x["k"], x["position"]): (x["mse"], x["cosine"], x["odd"]) for x in moments.patches(rows, ["k"], "a", "b", 2).collect()}
    assert got == {(1, 0): (0.0, 1.0, False), (1, 1): (0.0, 1.0, False), (2, 0): (None, None, True), (2, 1): (0.0, None, False), (3, 0): (None, None, True), (3, 1): (None, None, True)}
    assert {x["position"]: x["status"] for x in moments.by_position(moments.patches(rows.where("k = 1"), ["k"], "a", "b", 2)).collect()} == {0: "PASS", 1: "PASS"}
    assert {x["status"] for x in moments.by_position(moments.patches(rows, ["k"], "a", "b", 2)).collect()} == {"FAIL"}


def test_counters(spark):
    rows = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b"), ("x", "c"), ("x", None), (None, "d")], "g string, k string")
    got = {r["g"]: (r["counts"], r["total"], r["other"]) for r in counters.count_maps(rows, ["g"], "k", 2).collect()}
    assert got == {"x": ({"a": 2, "b": 1}, 5, 2), None: ({"d": 1}, 1, 0)}
    merged = counters.roll_up(counters.count_maps(rows, ["g"], "k", 9), []).first()
    assert (merged["counts"], merged["total"], merged["other"]) == ({"a": 2, "b": 1, "c": 1, "d": 1}, 6, 1)
    m = lambda **x: F.create_map(*(F.lit(y) for kv in x.items() for y in kv)).cast("map<string,bigint>")
    one = spark.range(1).select(counters.merge(m(a=1, b=2), m(b=3, c=4)).alias("m"), counters.merge(F.lit(None).cast("map<string,bigint>"), m(a=1)).alias("n"), counters.look_up(m(a=1), F.lit("a")).alias("x"), counters.look_up(m(a=1), F.lit("z")).alias("y"), counters.look_up(m(a=1), F.lit(None)).alias("z")).first()
    assert tuple(one) == ({"a": 1, "b": 5, "c": 4}, {"a": 1}, "1", counters.ABSENT, counters.ABSENT)
    known = spark.createDataFrame([("a", 1, None), ("b", 2, "p"), ("b", 3, "q"), (None, 4, "r")], "k string, u int, v string")
    found = {r["k"]: (r["status"], r["payload"]) for r in counters.payload(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "k string"), known, "k", ["u", "v"]).collect()}
    assert found == {"a": ("found", {"u": "1", "v": ""}), "b": ("ambiguous", {}), "z": (counters.ABSENT, {}), None: (counters.ABSENT, {})}


def plain_digest(texts, size):
    level = [hashlib.sha256("".join(t + "\n" for t in texts[i : i + size]).encode()).hexdigest() for i in range(0, len(texts), size)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(h + "\n" for h in level[i : i + size]).encode()).hexdigest() for i in range(0, len(level), size)]
    return level[0]


def test_digest_tree(spark):
    rows = [("one", i, f"t{i}") for i in range(100)] + [("two", i, f"t{i}") for i in range(3)] + [(None, 1, None)]
    want = {"one": plain_digest([f"t{i}" for i in range(100)], 4), "two": plain_digest(["t0", "t1", "t2"], 4), None: plain_digest([""], 4)}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "s string, i int, t string").repartition(parts)
        assert {r["s"]: r["content_hash"] for r in digests.root(digests.leaves(df, ["s"], ["i"], F.col("t"), 4), ["s"], 4).collect()} == want


def test_progress_of_runs(spark, tmp_path):
    folder = tmp_path / "in"
    batches = [
        [("m", 1, 1, 0.5, 1.0), ("m", 1, 2, 0.6, 1.0), ("m", 1, 3, 0.6, 0.9), ("n", 1, 1, 0.1, 1.0)],
        [("m", 1, 3, 0.6, 0.9), ("m", 1, 4, 0.60001, 1.0), ("n", 1, 1, 0.1, 1.0)],
        [("m", 2, 3, 0.4, 1.0), ("m", 2, 4, 0.7, 1.0), ("n", 1, 2, None, 1.0)],
        [("m", 1, 9, 0.99, 0.1), ("m", 2, 4, 0.7, 1.0)],
    ]
    schema, said = "run string, attempt int, step long, value double, loss double", []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        q = epochs.run_progress(epochs.stream_rows(spark, str(folder), schema), 1e-4, 2).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n, i=i: said.extend((i, *r) for r in df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(i, run): rest for i, run, *rest in said}
    assert got == {
        (0, "m"): [1, 3, 3, 0.6, 0.6, 1, False],
        (0, "n"): [1, 1, 1, 0.1, 0.1, 0, False],
        (1, "m"): [1, 4, 4, 0.60001, 0.6, 2, True],
        (2, "m"): [2, 4, 4, 0.7, 0.7, 0, False],
    }
