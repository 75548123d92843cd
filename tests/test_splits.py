"""Grouped splits, repaired sizes, running sums and places, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import metrics, relate, splits


@pytest.mark.parametrize("seed", range(40))
def test_quotas_are_met(seed):
    r = np.random.default_rng(seed)
    kinds = np.unique(r.random((r.integers(1, 25), r.integers(1, 6))) < 0.4, axis=0).astype(int)
    sizes = r.integers(1, (5, 60, 5000)[seed % 3], len(kinds))
    dealt = splits.deal(kinds, sizes)
    assert (dealt.sum(axis=1) == sizes).all() and (dealt >= 0).all()
    assert np.abs(kinds.T @ dealt - splits.quotas(sizes @ kinds)).max() <= 1
    assert np.abs(dealt.sum(axis=0) - splits.quotas(sizes.sum())).max() <= 1


def test_grouped_split_takes_null_labels(spark):
    rows = [(i, [None, "a"] if i % 3 == 0 else None if i % 3 == 1 else ["b", "a", "b"]) for i in range(90)]
    got = {r["id"]: r["split"] for r in splits.grouped_split(spark.createDataFrame(rows, "id long, labels array<string>")).collect()}
    assert sorted(got) == list(range(90))
    for rest in range(3):
        own = [got[i] for i in range(90) if i % 3 == rest]
        assert [own.count(s) for s in splits.SPLITS] == [24, 3, 3]
    assert splits.grouped_split(spark.createDataFrame([], "id long, labels array<string>")).count() == 0


def plain_moves(rows, wanted):
    """Every row of every split with too many, tried in every split with too few; the least squares win."""
    held, out = dict(rows), []
    labels = sorted({c for own, _ in rows.values() for c in own})
    share = {s: [wanted[s] / sum(wanted.values()) * sum(c in own for own, _ in rows.values()) for c in labels] for s in wanted}

    def squares(moved, to):
        total = 0.0
        for s in wanted:
            counts = [sum(c in own for i, (own, at) in held.items() if (to if i == moved else at) == s) for c in labels]
            total += sum((a - b) ** 2 for a, b in zip(counts, share[s]))
        return round(total, 6)

    while True:
        size = {s: sum(at == s for _, at in held.values()) for s in wanted}
        tries = [(squares(i, to), len(own), i, at, to) for i, (own, at) in held.items() if size[at] > wanted[at] for to in wanted if size[to] < wanted[to]]
        if not tries:
            return out
        _, _, i, at, to = min(tries)
        out.append((i, at, to))
        held[i] = held[i][0], to


@pytest.mark.parametrize("seed", range(3))
def test_repair_equals_the_plain_search(spark, seed):
    r = random.Random(seed)
    rows = {f"i{k:03d}": (sorted(r.sample("abc", r.randrange(3))), r.choice(("train", "train", "val", "test"))) for k in range(60)}
    wanted = {"train": 48, "val": 6, "test": 6}
    df = spark.createDataFrame([(i, own, at) for i, (own, at) in rows.items()], "id string, labels array<string>, split string")
    got = {x["id"]: (x["moved_from"], x["split"]) for x in splits.repair_sizes(df, wanted).collect()}
    moves = {i: (at, to) for i, at, to in plain_moves(rows, wanted)}
    assert {i: v for i, v in got.items() if v[0]} == moves and len(got) == 60
    assert [sum(s == to for _, to in got.values()) for s in wanted] == list(wanted.values())
    with pytest.raises(ValueError):
        splits.repair_sizes(df, wanted, most_moves=0)
    with pytest.raises(ValueError):
        splits.repair_sizes(df, wanted | {"train": 50})


def test_running_sums_across_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice((None, 1, 2, 2, 2, 2)), i, r.randrange(10)) for i in range(400)]
    got = {x["i"]: x["s"] for x in relate.running_sums(spark.createDataFrame(rows, "k int, i int, v int").repartition(5), ["k"], [F.desc("i")], {"s": F.col("v")}).collect()}
    for k, i, _ in rows:
        assert got[i] == sum(v for a, b, v in rows if a == k and b >= i)


def test_one_sort_gives_the_areas_of_all_classes(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(3), r.randrange(8) / 8) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, truth int, p double")
    got = {x["class"]: x for x in metrics.one_against_rest(df, "p", "truth", "i").collect()}
    k = spark.range(3).select(F.col("id").cast("int").alias("k"))
    long = df.crossJoin(k).withColumn("y", (F.col("truth") == F.col("k")).cast("int"))
    stable, tied, ap = ({x["k"]: x[1] for x in f.collect()} for f in (metrics.auroc_stable(long, "p", "y", "i", ("k",)), metrics.auroc_tied(long, "p", "y", ("k",)), metrics.average_precision(long, "p", "y", ("k",))))
    for c in range(3):
        yes, no = ([(p, -i) for i, t, p in rows if (t == c) == own] for own in (True, False))
        area = sum(a > b for a in yes for b in no) / len(yes) / len(no)
        ties = sum((a[0] > b[0]) + (a[0] == b[0]) / 2 for a in yes for b in no) / len(yes) / len(no)
        precision = sum(sum(x[0] >= a[0] for x in yes) / sum(x[0] >= a[0] for x in yes + no) for a in yes) / len(yes)
        assert (got[c]["auroc_stable"], got[c]["auroc"], got[c]["average_precision"]) == pytest.approx((area, ties, precision))
        assert (stable[c], tied[c], ap[c]) == pytest.approx((area, ties, precision))
    one = metrics.one_against_rest(df.where("truth = 1"), "p", "truth", "i").collect()
    assert [(x["auroc"], x["average_precision"]) for x in one] == [(None, None)]
