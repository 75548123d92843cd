"""Thresholds met exactly, repeated and null ids, labels of one value, very long texts, and empty inputs of every stage."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import decontaminate, divergence, lang_id, license_scan, line_dedup, ngram_join, packing, rule_ensemble
from cairn.llm.registry import vocabulary_path
from tests.llm import brute

R = random.Random(17)
WORDS = ["".join(R.choice("etaoinshrdlu") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def plain_statistics(text):
    t = text or ""
    count = lambda p: len(re.findall(p, t))
    words = [w for w in re.split(r"\s+", t.lower()) if w]
    lines = [x for x in t.split("\n") if x]
    chars, n, m = max(len(t), 1), max(len(words), 1), max(len(lines), 1)
    classes = {"upper": count("[A-Z]"), "digit": count("[0-9]"), "mark": count(r"[.,;:?'\"()\-]"), "symbol": count(r"[!#*$%&|<>]"), "space": count(r"\s")}
    other = len(t) - sum(classes.values()) - count("[a-z]")
    out = {k: v / chars for k, v in (classes | {"other": other}).items()}
    out |= {"log_words": math.log1p(len(words)), "word_length": (chars - classes["space"]) / n, "repeated_words": 1 - len(set(words)) / n, "repeated_lines": 1 - len(set(lines)) / m, "line_words": len(words) / m}
    return [out[f] for f in rule_ensemble.FEATURES]


TEXTS = ["", None, "One two, two!", "a\n\na\nb 12", "  X@_y  ", "((--))", prose(60, 1) + "\n" + prose(5, 2), "$" * 30, "\n\n", prose(20_000, 3)]


def test_statistics_and_scores_by_the_plain_rule(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    held = {r["doc_id"]: [r[f"f_{f}"] for f in rule_ensemble.FEATURES] for r in rule_ensemble.with_statistics(rows).collect()}
    for i, t in enumerate(TEXTS):
        assert held[i] == pytest.approx(plain_statistics(t))
    f = rule_ensemble.FEATURES.index
    rules = (rule_ensemble.Rule(((f("symbol"), False, 0.1),), -2.5), rule_ensemble.Rule(((f("log_words"), True, 2.0), (f("upper"), True, 0.0)), 1.25), rule_ensemble.Rule(((f("repeated_words"), False, 0.2),), 0.5))
    model = rule_ensemble.Ensemble(-0.3, rules)
    got = {r["doc_id"]: r for r in rule_ensemble.predict(rows, model).collect()}
    for i, t in enumerate(TEXTS):
        x = plain_statistics(t)
        total = -0.3 + sum(r.weight for r in rules if all((x[k] <= at) == below for k, below, at in r.tests))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-total))) and got[i]["predicted"] == (got[i]["score"] >= 0.3)
        assert bool(rules[1].holds(np.array([x]))[0]) == (len((t or "").split()) <= 6 and not re.search("[A-Z]", t or ""))


def test_lasso_and_split_against_plain_search():
    r = np.random.default_rng(4)
    x, y = r.random((200, 2)), r.integers(0, 2, 200).astype(float)
    grid = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 49))) for k in range(2)]
    target = y - y.mean()
    gains = {(k, t): target[x[:, k] <= t].sum() ** 2 / (x[:, k] <= t).sum() + target[x[:, k] > t].sum() ** 2 / (x[:, k] > t).sum() for k in range(2) for t in grid[k] if min((x[:, k] <= t).sum(), (x[:, k] > t).sum()) >= 10}
    found = rule_ensemble._best_split(x, target, grid)
    assert found[0] == pytest.approx(max(gains.values())) and gains[found[1:]] == pytest.approx(found[0])
    rules = r.integers(0, 2, (200, 6)).astype(float)
    truth = 1 / (1 + np.exp(-(2 * rules[:, 0] - 2 * rules[:, 1])))
    label = (r.random(200) < truth).astype(float)
    loss = lambda b, w: np.mean(np.logaddexp(0, b + rules @ w) - label * (b + rules @ w)) + 0.02 * np.abs(w).sum()
    b, w = rule_ensemble.lasso_logistic(rules, label, 0.02)
    assert all(loss(b, w) <= loss(b + db, w + dw) + 1e-7 for db in (-1e-3, 0, 1e-3) for dw in (*(1e-3 * np.eye(6)), *(-1e-3 * np.eye(6))))
    assert w[0] > 0.3 and w[1] < -0.3 and np.abs(w[2:]).max() < 0.3 and (np.abs(w[2:]) < 1e-9).any()


def test_classifier_on_repeated_ids_and_single_labels(spark):
    rows = [(i, prose(60, i)) for i in range(30)] + [(30 + i, "$$ " * 40) for i in range(30)]
    again = rows + [rows[0], (rows[1][0], "zz other text"), (None, rows[2][1]), (None, None)]
    docs = spark.createDataFrame(again, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(0, 0), (5, None), (None, 1), (999, 1)], "doc_id long, quality int")
    got = rule_ensemble.predict(docs, rule_ensemble.fit(docs, labels, trees=5)).collect()
    assert len(got) == len(again) and all(0 <= r["score"] <= 1 for r in got)
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((i for i, _ in again), key=repr)
    assert len({round(r["score"], 9) for r in got if r["doc_id"] == 0}) == 1
    one = rule_ensemble.fit(docs, labels.withColumn("quality", F.lit(1)), trees=3)
    assert all(r["score"] > 0.9 for r in rule_ensemble.predict(docs, one).collect())
    none = rule_ensemble.fit(docs.limit(0), labels)
    assert {r["score"] for r in rule_ensemble.predict(docs, none).collect()} == {0.5} and rule_ensemble.predict(docs.limit(0), one).count() == 0


def test_licenses_at_just_the_share(spark):
    template = [f"w{i}" for i in range(14)]  # ten shingles of five words
    texts = [" ".join(template[:12]), " ".join(template[:11]), " ".join(template), f"{prose(30, 1)} {' '.join(template[:12])} {prose(30, 2)}"]
    rows = spark.createDataFrame([(None, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (3, texts[3])], "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"] or 0, r["licenses"], r["best_percent"]) for r in license_scan.scan_licenses(rows, {"t": " ".join(template)}).collect())
    assert [x[:2] for x in got] == [(0, "t"), (1, ""), (2, "t"), (2, "t"), (3, "t")] and [x[2] for x in got if x[1]] == [80, 100, 100, 80]


def test_packing_of_repeated_and_null_ids(spark):
    rows = [(1, prose(50, 1)), (1, prose(50, 1)), (1, prose(400, 2)), (None, prose(300, 3)), (None, None), (2, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocabulary_path()).collect()
    assert sorted(str(r["doc_id"]) for r in got if r["start"] == 0) == ["1", "1", "1", "2", "None", "None"]
    for sequence in {r["sequence_id"] for r in got}:
        own = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == sequence)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(n for _, n in own) <= 1024


def test_very_long_texts(spark):
    passage = prose(40, 5)
    long = f"{prose(120_000, 6)}\n{passage}\n{prose(60_000, 7)}\n{passage}"
    docs = spark.createDataFrame([(1, long), (2, passage), (3, long + " end"), (4, "word" * 100_000)], "doc_id long, text string")
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}
    judged = by_id(divergence.judge(docs.withColumn("lang", F.lit("en")), divergence.fit_references(docs.withColumn("lang", F.lit("en")))))
    for i, t in ((1, long), (3, long + " end"), (4, "word" * 100_000)):
        assert tuple(judged[i][1:7]) == brute.base_counts(t)
    hits = by_id(decontaminate.find_contamination(docs, spark.createDataFrame([(9, passage)], "item_id long, text string")))
    assert [hits[i]["n_hit"] for i in (1, 2, 3, 4)] == [80, 40, 80, 0] and hits[2]["contaminated"] and not hits[1]["contaminated"]
    lines = by_id(line_dedup.dedup_lines(docs, with_text=True))
    assert lines[1]["kept_text"] == "\n".join(long.split("\n")[:3]) and lines[2]["kept_text"] == "" and lines[4]["kept_text"] == "word" * 100_000
    groups = by_id(ngram_join.jaccard_components(docs))
    assert groups[1]["component_id"] == groups[3]["component_id"] == 1 and groups[2]["component_id"] == 2
    assert groups[1]["n_shingles"] == len({tuple(w) for w in zip(*(long.lower().split()[k:] for k in range(5)))})
    small = spark.createDataFrame([(i, prose(30, i), "xx") for i in range(10)] + [(20 + i, "ñandú über straße " * 8, "yy") for i in range(10)], "doc_id long, text string, lang string")
    found = by_id(lang_id.predict(docs, lang_id.fit(small)))
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["xx"] * 3 and all(0 <= r["score"] <= 1 for r in found.values())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, prose(20, 1))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
