"""Evaluation of classifiers from prediction tables: counts first, then ratios; no row order is relied upon unless named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.cols import ratio
from cairn.functions.special import half_binomial_tail
from cairn.operators.graph import ensure_checkpoint_dir
from cairn.operators.relate import numbered, running_sums


def confusion(rows: DataFrame, classes: int, truth: str = "truth", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, truth, predicted, n) for every cell of a table, zeros included."""
    counts = rows.groupBy(*by, F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    k = rows.sparkSession.range(classes)
    cells = k.select(F.col("id").cast("int").alias("truth")).crossJoin(k.select(F.col("id").cast("int").alias("predicted")))
    cells = rows.select(*by).distinct().crossJoin(cells) if by else cells
    return cells.join(counts, [*by, "truth", "predicted"], "left").fillna(0, ["n"])


def per_class(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One-against-rest counts and precision, recall, F1, support of each class."""
    rows = cells.groupBy(*by, F.col("truth").alias("class_id")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cells.groupBy(*by, F.col("predicted").alias("class_id")).agg(F.sum("n").alias("called"))
    total = F.sum("support").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))
    out = rows.join(cols, [*by, "class_id"]).withColumn("total", total)
    fp, fn = F.col("called") - F.col("tp"), F.col("support") - F.col("tp")
    p, r = ratio(F.col("tp"), F.col("called")), ratio(F.col("tp"), F.col("support"))
    return out.select(*by, "class_id", "tp", fp.alias("fp"), fn.alias("fn"), (F.col("total") - F.col("tp") - fp - fn).alias("tn"), "support", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def overall(classes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    n = F.sum("support")
    return classes.groupBy(*by).agg(ratio(F.sum("tp"), n).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"))


def auroc_stable(rows: DataFrame, score: str, truth: str, order: str, by: tuple[str, ...]) -> DataFrame:
    """Area under the step curve of rows by falling score, equal scores in row order; null where a side is empty."""
    y = F.col(truth).cast("long")
    steps = running_sums(rows.select(*by, score, truth, order), list(by), [F.desc(score), F.asc(order)], {"_tp": y})
    area = F.sum(F.when(y == 0, F.col("_tp").cast("decimal(20,0)")))
    pos, neg = F.sum(y).cast("double"), F.sum(1 - y).cast("double")
    return steps.groupBy(*by).agg(F.try_divide(area.cast("double"), pos * neg).alias("auroc"))


def score_steps(rows: DataFrame, score: str, truth: str, by: tuple[str, ...]) -> DataFrame:
    """(by, _p, pos, neg, tp, called): counts of each distinct score, and what it and all higher ones hold."""
    y = F.col(truth).cast("long")
    counts = rows.groupBy(*by, F.col(score).alias("_p")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    return running_sums(counts, list(by), [F.desc("_p")], {"tp": F.col("pos"), "called": F.col("pos") + F.col("neg")})


def _areas() -> dict[str, Column]:
    """Of score steps: the area where equal scores are one step (the Mann-Whitney statistic), and the average precision."""
    auroc = F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.sum("pos").cast("double") * F.sum("neg"))
    return {"auroc": auroc, "average_precision": F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("called")), F.sum("pos").cast("double"))}


def auroc_tied(rows: DataFrame, score: str, truth: str, by: tuple[str, ...]) -> DataFrame:
    return score_steps(rows, score, truth, by).groupBy(*by).agg(_areas()["auroc"].alias("auroc"))


def average_precision(rows: DataFrame, score: str, truth: str, by: tuple[str, ...]) -> DataFrame:
    return score_steps(rows, score, truth, by).groupBy(*by).agg(_areas()["average_precision"].alias("average_precision"))


def one_against_rest(rows: DataFrame, score: str, truth: str, order: str) -> DataFrame:
    """(class, auroc_stable, auroc, average_precision) where all classes share one score; rows are sorted once, not once a class.

    A class's area is what its rows' places leave below them, less the pairs of its own rows: with places of rows where
    equal scores keep row order, with the mean of their places where they are one step. Null for a class without rows of
    its own or of others.
    """
    placed = numbered(rows.select(score, F.col(truth).alias("_k"), order), [], [F.desc(score), F.asc(order)], "_place")
    counts = placed.groupBy("_k", F.col(score).alias("_p")).agg(F.count("*").alias("n"), F.sum(F.col("_place").cast("decimal(20,0)")).alias("places"))
    counts = counts.checkpoint()
    steps = running_sums(counts.groupBy("_p").agg(F.sum("n").alias("all")), [], [F.desc("_p")], {"called": F.col("all")})
    own = running_sums(counts, ["_k"], [F.desc("_p")], {"tp": F.col("n")}).join(steps, "_p")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    twice = F.sum(F.col("n") * (2 * big("called") - big("all") - 1))  # twice the sum of places, equal scores at their mean
    summed = own.groupBy("_k").agg(F.sum("n").alias("n"), F.sum("places").alias("places"), twice.alias("twice"), F.sum(F.col("n") * F.col("tp") / F.col("called")).alias("_ap")).crossJoin(F.broadcast(whole))
    n, rest = F.col("n").cast("double"), (F.col("whole") - F.col("n")).cast("double")
    pairs = n * (n - 1) / 2
    area = lambda places: F.try_divide(n * (F.col("whole") - 1) - places.cast("double") - pairs, n * rest)
    return summed.select(F.col("_k").alias("class"), area(F.col("places")).alias("auroc_stable"), area(F.col("twice") / 2).alias("auroc"), F.when(rest > 0, F.col("_ap") / n).alias("average_precision"))


def threshold_search(rows: DataFrame, score: str, truth: str, by: tuple[str, ...]) -> DataFrame:
    """Of the thresholds .05, .06 .. .95, the one with the best F1; of equals, the nearest to .5, then the smaller.

    Scores are counted per grid step first, so the work does not depend on the number of rows times that of steps.
    """
    grid = rows.sparkSession.range(5, 96).select((F.col("id") / F.lit(100.0)).alias("threshold"))
    y = F.col(truth).cast("long")
    # Scores between two grid values act alike: a row counts for the last threshold that it reaches.
    reach = F.floor(F.col(score) * 100)
    reach = reach + F.when((reach + 1) / F.lit(100.0) <= F.col(score), 1).when(reach / F.lit(100.0) > F.col(score), -1).otherwise(0)
    steps = rows.groupBy(*by, F.least(reach, F.lit(95)).alias("_r")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    total = steps.groupBy(*by).agg(F.sum("pos").alias("support"))
    joined = total.crossJoin(grid).join(steps, list(by)).groupBy(*by, "threshold", "support")
    hit = F.col("_r") / F.lit(100.0) >= F.col("threshold")
    counted = joined.agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("called"))
    f1 = ratio(2 * F.col("tp"), F.col("called") + F.col("support"))
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.abs(F.col("threshold") - 0.5), -F.col("threshold"))).alias("b")
    return counted.withColumn("f1", f1).groupBy(*by).agg(best).select(*by, "b.threshold", "b.f1")


def sample_metrics(truth: Column, predicted: Column) -> dict[str, Column]:
    """Counts, id lists and ratios of one sample's 0/1 vectors; all null where there is no truth."""
    both = F.zip_with(truth, predicted, lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    count = lambda t, p: F.size(F.filter(both, lambda x: (x["t"] == t) & (x["p"] == p)))
    ids = lambda t, p: F.filter(F.transform(both, lambda x, i: F.when((x["t"] == t) & (x["p"] == p), i)), lambda x: x.isNotNull())
    tp, fp, fn, tn = count(1, 1), count(0, 1), count(1, 0), count(0, 0)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "missed": ids(1, 0), "extra": ids(0, 1), "exact_match": truth == predicted, "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}
    return {k: F.when(truth.isNotNull(), v) for k, v in out.items()}


def log_loss(p: Column) -> Column:
    return F.avg(-F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))))


def holm(tests: DataFrame, p: str = "p", order: str = "name", alpha: float = 0.05) -> DataFrame:
    """Step-down adjustment of a handful of tests: rank, (m - rank + 1) p, running maximum, at most 1."""
    w = W.partitionBy(F.lit(0)).orderBy(p, order)
    m = F.count("*").over(W.partitionBy(F.lit(0)))
    raw = (m - F.row_number().over(w) + 1) * F.col(p)
    out = tests.withColumn("_raw", raw).withColumn("adjusted", F.least(F.lit(1.0), F.max("_raw").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))))
    return out.withColumn("rejected", F.col("adjusted") < alpha).drop("_raw")


def exact_tail(b: Column, c: Column) -> Column:
    """Two-sided binomial tail of discordant counts (the exact McNemar test), at most 1 and 1 where there are none.

    A fixed number of terms for any counts; no Python workers. To about 12 digits.
    """
    n = b + c
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * half_binomial_tail(n, F.least(b, c))))


def mcnemar_pairs(rows: DataFrame, truth: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(pair, b, c, chi2): rows that only the first or only the second model of each pair has right, from one scan."""
    right = {m: F.col(m) == F.col(truth) for p in pairs.values() for m in p}
    counts = [F.struct(F.lit(k).alias("pair"), F.count_if(right[a] & ~right[b]).alias("b"), F.count_if(right[b] & ~right[a]).alias("c")) for k, (a, b) in pairs.items()]
    out = rows.agg(F.array(*counts).alias("x")).select(F.inline("x"))
    return out.withColumn("chi2", ratio(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)), F.col("b") + F.col("c")))


def threshold_free(rows: DataFrame, score: str, truth: str, by: str) -> DataFrame:
    """Macro and micro AUROC and average precision of one-against-rest rows; micro takes all classes as one. Rows are counted once."""
    ensure_checkpoint_dir(rows.sparkSession)
    counts = rows.groupBy(by, F.col(score).alias("_p")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg")).checkpoint()
    sums = {"tp": F.col("pos"), "called": F.col("pos") + F.col("neg")}
    each = running_sums(counts, [by], [F.desc("_p")], sums).groupBy(by).agg(*(c.alias(n) for n, c in _areas().items()))
    macro = each.agg(*(F.avg(n).alias(f"macro_{n}") for n in _areas()))
    one = counts.groupBy("_p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    micro = running_sums(one, [], [F.desc("_p")], sums).agg(*(c.alias(f"micro_{n}") for n, c in _areas().items()))
    return macro.crossJoin(micro)


def roc_points(rows: DataFrame, score: str, truth: str, by: str) -> DataFrame:
    """(by, tp, fp, threshold, tpr, fpr) after each distinct score by falling score, and the origin of each class (threshold null)."""
    steps = score_steps(rows, score, truth, (by,)).checkpoint()
    every = steps.groupBy(by).agg(F.sum("pos").alias("_p_all"), F.sum("neg").alias("_n_all"))
    share = lambda a, b: F.try_divide(a.cast("double"), F.col(b).cast("double"))
    fp = F.col("called") - F.col("tp")
    points = steps.join(every, by).select(by, "tp", fp.alias("fp"), F.col("_p").alias("threshold"), share(F.col("tp"), "_p_all").alias("tpr"), share(fp, "_n_all").alias("fpr"))
    zero = every.select(by, F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return points.unionByName(zero)


def thresholded(rows: DataFrame, score: str, truth: str, by: str, threshold: float) -> DataFrame:
    """Counts and ratios of each class at a threshold, with its AUROC and average precision."""
    y, called = F.col(truth) == 1, F.col(score) >= threshold
    counts = rows.groupBy(by).agg(F.count_if(y & called).alias("tp"), F.count_if(~y & called).alias("fp"), F.count_if(y & ~called).alias("fn"), F.count_if(~y & ~called).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
    return out.join(score_steps(rows, score, truth, (by,)).groupBy(by).agg(*(c.alias(n) for n, c in _areas().items())), by)


def probability_rows(rows: DataFrame, key: list[str], p: str, t: str) -> DataFrame:
    """(key, class_id, p, threshold, decision): an array of probabilities as a row a class, with its threshold and whether it is reached."""
    each = rows.select(*key, F.posexplode(F.arrays_zip(F.col(p).alias("p"), F.col(t).alias("t"))).alias("class_id", "x"))
    return each.select(*key, "class_id", F.col("x.p").alias("p"), F.col("x.t").alias("threshold"), (F.col("x.p") >= F.col("x.t")).alias("decision"))


def multilabel_summary(rows: DataFrame, truth: Column, predicted: Column, classes: int) -> DataFrame:
    """One row: micro_f1, macro_f1, hamming and subset_accuracy of 0/1 vectors; ratios without a denominator are 0."""
    both = F.zip_with(truth, predicted, lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    v = rows.select(both.alias("v"))
    wrong = F.aggregate("v", F.lit(0), lambda a, x: a + F.abs(x["t"] - x["p"]))
    by_row = v.agg(F.avg(wrong / float(classes)).alias("hamming"), F.avg((wrong == 0).cast("double")).alias("subset_accuracy"))
    c = v.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x.t") * F.col("x.p")).alias("tp"), F.sum("x.t").alias("s"), F.sum("x.p").alias("q"))
    by_class = c.agg(ratio(2 * F.sum("tp"), F.sum(F.col("s") + F.col("q"))).alias("micro_f1"), F.avg(ratio(2 * F.col("tp"), F.col("s") + F.col("q"))).alias("macro_f1"))
    return by_class.crossJoin(by_row)


def multilabel_f1(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """weighted_f1 (by the classes' support) and samples_f1 (mean over rows; 0 for a row with neither labels nor predictions)."""
    both = F.zip_with(truth, predicted, lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    v = rows.select(both.alias("v"))
    total = lambda f: F.aggregate("v", F.lit(0), lambda a, x: a + f(x))
    samples = v.agg(F.avg(ratio(2 * total(lambda x: x["t"] * x["p"]), total(lambda x: x["t"] + x["p"]))).alias("samples_f1"))
    c = v.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x.t") * F.col("x.p")).alias("tp"), F.sum("x.t").alias("s"), F.sum("x.p").alias("q"))
    weighted = c.agg(ratio(F.sum(ratio(2 * F.col("tp"), F.col("s") + F.col("q")) * F.col("s")), F.sum("s")).alias("weighted_f1"))
    return weighted.crossJoin(samples)


def normalised_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """(truth, predicted, difference): the second confusion table less the first one, each by its row's sum; 0 for an empty row."""
    share = lambda x, name: x.select("truth", "predicted", ratio(F.col("n"), F.sum("n").over(W.partitionBy("truth"))).alias(name))
    both = share(first, "_a").join(share(second, "_b"), ["truth", "predicted"])
    return both.select("truth", "predicted", (F.col("_b") - F.col("_a")).alias("difference"))
