from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from cairn.functions import cols
from cairn.operators import graph, history, metrics, splits

#: Published confusion matrices and the metrics that follow from them.
GOLDEN = {
    "baseline": ([[77, 0, 0, 0, 0], [0, 77, 0, 1, 0], [0, 0, 51, 21, 40], [2, 1, 4, 99, 0], [0, 0, 20, 2, 59]], (0.799559471366, 0.808540135245, 0.820978791183, 0.807999579266, 0.790428159968)),
    "cls": ([[77, 0, 0, 0, 0], [0, 77, 0, 1, 0], [0, 0, 52, 24, 36], [2, 0, 2, 100, 2], [0, 0, 26, 1, 54]], (0.792951541850, 0.801058171939, 0.812305618909, 0.801748192622, 0.784409792305)),
    "patch": ([[77, 0, 0, 0, 0], [0, 77, 0, 1, 0], [0, 0, 65, 25, 22], [2, 0, 2, 102, 0], [0, 0, 37, 2, 42]], (0.799559471366, 0.808109785784, 0.809663859900, 0.805259370123, 0.791780305482)),
}


def test_golden_matrices(spark):
    rows = [(m, t, p, n) for m, (cells, _) in GOLDEN.items() for t, row in enumerate(cells) for p, n in enumerate(row)]
    cells = spark.createDataFrame(rows, "model string, truth int, predicted int, n long")
    got = {r["model"]: r for r in metrics.overall(metrics.per_class(cells, ("model",)), ("model",)).collect()}
    for model, (_, want) in GOLDEN.items():
        assert tuple(got[model])[1:] == pytest.approx(want, abs=1e-11)


def test_tie_rules(spark):
    rows = spark.createDataFrame([(0, 0, 0.5, 0), (0, 1, 0.5, 1)], "g int, i int, p double, y int")
    assert metrics.auroc_stable(rows, "p", "y", "i", ("g",)).first()["auroc"] == 0.0
    assert metrics.auroc_tied(rows, "p", "y", ("g",)).first()["auroc"] == 0.5
    none = spark.createDataFrame([(0, 0.0, 0), (0, 0.01, 0)], "g int, p double, y int")
    assert metrics.threshold_search(none, "p", "y", ("g",)).first()["threshold"] == 0.5


def test_sample_metrics(spark):
    vector = lambda *x: F.array(*map(F.lit, x))
    got = spark.range(1).select(*(c.alias(k) for k, c in metrics.sample_metrics(vector(1, 0, 1, 0, 1), vector(1, 1, 0, 0, 1)).items())).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"], got["missed"], got["extra"]) == (2, 1, 1, 1, [2], [1])
    assert got["f1"] == pytest.approx(2 / 3)
    got = spark.range(1).select(*(c.alias(k) for k, c in metrics.sample_metrics(F.lit(None).cast("array<int>"), vector(1)).items())).first()
    assert all(x is None for x in got)


def test_mcnemar_and_holm(spark):
    rows = spark.createDataFrame([(3, 5), (10, 20), (0, 6), (0, 0)], "b int, c int")
    assert [r[0] for r in rows.select(metrics.exact_tail(F.col("b"), F.col("c"))).collect()] == pytest.approx([0.7265625, 0.09873714670538902, 0.03125, 1.0])
    counts = [(b, c) for b in range(25) for c in range(25)] + [(600, 610), (3000, 3100), (3, 2500)]
    got = spark.createDataFrame(counts, "b long, c long").select("b", "c", metrics.exact_tail(F.col("b"), F.col("c")).alias("p")).collect()
    for b, c, p in got:
        n, least = b + c, min(b, c)
        whole = min(1.0, float(Fraction(2 * sum(comb(n, i) for i in range(least + 1)), 2**n)))
        assert p == pytest.approx(whole, rel=1e-10)
    far = spark.createDataFrame([(10**6, 10**6 + 2000), (10**9, 10**9 + 10**5)], "b long, c long").select(metrics.exact_tail(F.col("b"), F.col("c")).alias("p")).collect()
    assert [r["p"] for r in far] == pytest.approx([0.1577144701, 0.0253524447], rel=1e-6)  # the normal limit with its half step
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r["name"]: round(r["adjusted"], 9) for r in metrics.holm(tests).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_early_stopping_components_targets(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate((0.5, 0.55, 0.58, 0.62))], "m int, e int, v double")
    got = history.early_stopping(rows, ["m"], "e", "v", 0.1).first()
    assert (got["reference"], got["steps_since"]) == (0.62, 0)
    keys = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 3), ("e", 3), ("f", None)], "n string, k int")
    assert {r["node"]: r["root"] for r in graph.shared_key_components(keys, "n", "k").collect()} == dict(zip("abcdef", "aaaddf"))
    got = spark.range(1).select(*(c.alias(k) for k, c in splits.targets(F.lit(25)).items())).first()
    assert tuple(got) == (20, 2, 3)
    groups = spark.createDataFrame([(f"g{i}", [i % 3]) for i in range(30)], "id string, labels array<int>")
    got = splits.grouped_split(groups).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 24, "val": 3, "test": 3}
    assert spark.range(1).select(cols.ratio(F.lit(1), F.lit(0))).first()[0] == 0.0
