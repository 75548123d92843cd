"""Queries that read whole tables, on small ones whose every row counts."""

import random

import numpy as np
import pytest

from cairn.operators import graph, resampling
from cairn.plans import catalogue


def run(spark, folder, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
    return [tuple(r) for r in catalogue.queries()[name](spark, str(folder)).collect()]


def test_components_of_all_orders(spark, tmp_path):
    r = random.Random(4)
    orders = [(i, r.randrange(1000)) for i in range(1, 700)]
    lines = [(i, r.randrange(1500)) for i, _ in orders if i % 5]
    got = run(spark, tmp_path, "components", orders=(orders, "o_orderkey long, o_custkey long"), lineitem=(lines, "l_orderkey long, l_partkey long"))
    root, first, customer = {c: c for _, c in orders}, {}, dict(orders)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for o, p in lines:
        a, b = sorted((find(customer[o]), find(first.setdefault(p, customer[o]))))
        root[b] = a
    assert sorted(got) == sorted((c, find(c)) for c in root)


def test_components_go_on_with_ends_only(spark):
    line = [(i, k) for i in range(200) for k in (i, i + 1)] + [(500, None), (501, 900), (502, 900), (501, 900), (None, 900)]
    got = graph.shared_key_components(spark.createDataFrame(line, "n long, k long"), "n", "k", rounds=2).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(200)] + [(500, 500), (501, 501), (502, 501)]


def test_reconcile_and_lookup_of_whole_tables(spark, tmp_path):
    turns = [(3, "user", "a"), (3, "assistant", "b"), (5, "user", "a"), (6, "assistant", "bb"), (15, "user", "a"), (15, "assistant", "b"), (15, "assistant", "bb")]
    got = run(spark, tmp_path, "review_reconcile", conversations=(turns, "conv_id long, role string, text string"))
    assert sorted(got) == [(3, "matched", 1), (5, "missing", 0), (6, "unmatched", 1), (15, "conflicting", 2)]
    got = run(spark, tmp_path, "gt_lookup", documents=([(1, "x", "en", 1), (3, "y", "de", 7), (5, "y", "de", 7)], "doc_id long, text string, lang string, n_chars long"))
    assert sorted(got) == [(1, 1, "sha256"), (3, 3, "image_id"), (5, 3, "image_id")]


def test_log_loss_counts_predictions_of_probability_zero(spark, tmp_path):
    got = run(spark, tmp_path, "log_loss", embeddings=([(0, 0), (50, 0)], "vec_id long, label int"))
    assert got == [(0, pytest.approx(690.775528))]


@pytest.mark.parametrize("leaf_size, rows_per_range", [(4096, 20_000), (2, 25)])
def test_bootstrap_of_metrics_equals_resampled_rows(spark, leaf_size, rows_per_range):
    r, k = random.Random(8), 3
    scores = lambda: [r.randrange(5) / 4 for _ in range(k)]
    rows = [(f"s{r.randrange(6)}", r.randrange(k), r.randrange(k), r.randrange(k), r.randrange(k), scores(), scores(), scores()) for _ in range(150)]
    df = spark.createDataFrame(rows, "cluster string, truth int, a int, b int, c int, s array<double>, t array<double>, u array<double>")
    models = {"x": ("a", "s"), "y": ("b", "t"), "z": ("c", "u")}
    found = resampling.replicate_metrics(df, models, k, 7, 5, block=3, per_task=6, leaf_size=leaf_size, rows_per_range=rows_per_range)
    got = {(x["rep"], x["pair"], x["metric"]): x["difference"] for x in resampling.paired_differences(found, [("x", "y"), ("x", "z"), ("y", "z")]).collect()}
    clusters = sorted({x[0] for x in rows})
    leaves = range(-(-len(clusters) // leaf_size))

    def plain(sample, p, s):
        f1, support, areas = [], [], []
        for c in range(k):
            tp = sum(x[1] == x[p] == c for x in sample)
            n, called = sum(x[1] == c for x in sample), sum(x[p] == c for x in sample)
            f1.append(2 * tp / (n + called) if n + called else 0.0), support.append(n)
            yes, no = [x[s][c] for x in sample if x[1] == c], [x[s][c] for x in sample if x[1] != c]
            areas.append(sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no)))
        return [sum(x[1] == x[p] for x in sample) / len(sample), sum(f1) / k, sum(a * b for a, b in zip(f1, support)) / len(sample), sum(areas) / k]

    for rep in range(7):
        size = min(3, 7 - rep // 3 * 3)
        times = np.concatenate([resampling.times_drawn(len(clusters), leaf, size, 5, rep // 3, leaf_size)[rep % 3] for leaf in leaves])
        assert times.sum() == len(clusters)
        sample = [x for x in rows for _ in range(times[clusters.index(x[0])])]
        one, two, three = (plain(sample, 2 + i, 5 + i) for i in range(3))
        for name, a, b, c in zip(resampling.METRICS, one, two, three):
            assert [got[rep, p, name] for p in ("y_minus_x", "z_minus_x", "z_minus_y")] == pytest.approx([b - a, c - a, c - b], abs=1e-12)


def test_draws_are_even():
    times = np.concatenate([resampling.times_drawn(50, leaf, 4000, 1, 0, 8) for leaf in range(7)], axis=1)
    assert (times.sum(1) == 50).all() and abs(times.mean(0) - 1).max() < 0.08 and abs(times.var(0) - 0.98).max() < 0.15
