import pytest
from pyspark.sql import functions as F

from cairn.operators import relate
from cairn.sources import readers, writers
from cairn.streaming import epochs


def test_csv_keeps_text_and_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfid,name\n007,\n8,\"a\nb\"\n")
    rows = readers.read_splits(spark, {"train": str(tmp_path / "a.csv")}).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("007", "", "train"), ("8", "a\nb", "train")]
    with pytest.raises(ValueError):
        readers.require_columns(spark.range(1), ["x"])


def test_file_index_and_reports(spark, tmp_path):
    for p in ("b/x.png", "a/x.jpg", "a/y.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"1")
    got = readers.file_index(spark, str(tmp_path)).collect()
    assert [(r["stem"], r["path"].endswith("a/x.jpg"), r["copies"]) for r in got] == [("x", True, 2)]
    (tmp_path / "r.txt").write_text("rows: 3\nnothing\nat: b: c\n")
    assert {tuple(r) for r in readers.key_values(spark, str(tmp_path / "r.txt")).collect()} == {("rows", "3"), ("at", "b: c")}
    log = spark.createDataFrame([(1, "[2024-01-01 00:00:00] resume"), (2, "[2024-01-01 00:01:00] resume"), (3, "[2024-01-01 00:03:30] stop"), (4, "[2024-01-01 00:09:00] stop")], "line_no int, value string")
    assert readers.wall_seconds(log, "resume", "stop").first()["seconds"] == 150


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, True), (2, 0.25, False)], "a int, b double, c boolean")
    assert writers.write_table(df, str(tmp_path / "t"), strict=True) == 2
    with pytest.raises(FileExistsError):
        writers.write_table(df, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        writers.write_table(df.union(df), str(tmp_path / "u"), strict=True)
    assert tuple(writers.canonical(df).orderBy("a").first()) == ("1", "0.500000000000", "TRUE")
    assert writers.fingerprint(df) == writers.fingerprint(df.orderBy(F.desc("a")))


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("m", "2024-01-01 01:00:00", 1.0), ("m", "2024-01-01 02:00:00", 3.0), ("m", "2024-01-02 02:00:00", 5.0)], "model string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    out = epochs.windowed(epochs.stream_rows(spark, str(tmp_path / "in"), rows.schema), ["model"], "ts", "v")
    q = out.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["mean"]) for r in spark.sql("SELECT * FROM windows").collect()) == [(1, 5.0), (2, 2.0)]


def test_reconcile_and_lookup(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    r = spark.createDataFrame([("a", "pass "), ("a", "pass"), ("b", "pass"), ("b", "fail"), ("z", None)], "k string, s string")
    assert {x["k"]: x["outcome"] for x in relate.reconcile(t, r, "k", ["s"]).collect()} == {"a": "matched", "b": "conflicting", "c": "missing", "z": "unmatched"}
    catalogue = spark.createDataFrame([("h", "i1", 1), ("h", "i2", 2), ("g", "i3", 3)], "sha string, name string, v int")
    asked = spark.createDataFrame([("h", "i2"), ("g", "other"), ("x", "none")], "sha string, name string")
    assert {(x["sha"], x["found"], x["method"]) for x in relate.lookup(asked, catalogue, "sha", "name", "v").collect()} == {("h", 2, "image_id"), ("g", 3, "sha256"), ("x", None, "none")}
