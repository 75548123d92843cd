"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees propose conjunctions, a logistic model with a lasso penalty weighs them, and those that keep a weight
are compiled to one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ["log_words", "word_length", "upper", "digit", "mark", "symbol", "other", "space", "repeated_words", "repeated_lines", "line_words"]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the statistics that rules test, as doubles named ``f_<name>``; an empty or null text has zeros."""
    out = docs.withColumn("_t0", F.coalesce(F.col(text_col), F.lit("")))
    classes = {"lower": r"\p{Ll}+", "space": r"\s+", "upper": r"\p{Lu}+", "digit": r"\p{N}+", "mark": r"[.,;:?'\"()\-]+", "symbol": r"[!#*$%&|<>]+"}
    for i, (name, pattern) in enumerate(classes.items()):
        out = out.withColumn(f"_t{i + 1}", F.regexp_replace(f"_t{i}", pattern, ""))
        out = out.withColumn(f"_n_{name}", F.length(f"_t{i}") - F.length(f"_t{i + 1}"))
    out = out.withColumn("_n_other", F.length(f"_t{len(classes)}")).withColumn("_chars", F.greatest(F.length("_t0"), F.lit(1)))
    out = out.withColumn("_words", F.filter(F.split(F.lower("_t0"), r"\s+"), lambda w: w != ""))
    out = out.withColumn("_lines", F.filter(F.split("_t0", "\n"), lambda x: F.length(x) > 0))
    words, lines = F.size("_words"), F.size("_lines")
    some = lambda n: F.greatest(n, F.lit(1))
    columns = {x: F.col(f"_n_{x}") / F.col("_chars") for x in ("upper", "digit", "mark", "symbol", "other", "space")}
    columns |= {
        "log_words": F.log1p(words),
        "word_length": (F.col("_chars") - F.col("_n_space")) / some(words),
        "repeated_words": 1 - F.size(F.array_distinct("_words")) / some(words),
        "repeated_lines": 1 - F.size(F.array_distinct("_lines")) / some(lines),
        "line_words": words / some(lines),
    }
    return out.select(*docs.columns, *(columns[x].cast("double").alias(f"f_{x}") for x in FEATURES))


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests (feature, at most, threshold), and its weight."""

    tests: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, below, t in self.tests:
            out &= (x[:, f] <= t) == below
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, below, t in self.tests:
            c = F.col(f"f_{FEATURES[f]}")
            out = out & (c <= t if below else c > t)
        return out


def _best_split(x: np.ndarray, target: np.ndarray, grid: list[np.ndarray]) -> tuple[float, int, float] | None:
    best, total, n = None, target.sum(), len(target)
    for f, cuts in enumerate(grid):
        if not len(cuts):
            continue
        at = np.searchsorted(cuts, x[:, f], side="left")
        count = np.cumsum(np.bincount(at, minlength=len(cuts) + 1))[:-1]
        left = np.cumsum(np.bincount(at, target, minlength=len(cuts) + 1))[:-1]
        ok = (count >= 10) & (n - count >= 10)
        if ok.any():
            gain = np.where(ok, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1), -np.inf)
            i = int(gain.argmax())
            if best is None or gain[i] > best[0] + 1e-12:
                best = float(gain[i]), f, float(cuts[i])
    return best if best and best[0] > total**2 / n + 1e-9 else None


def _grow(x, target, rows, grid, depth, path, rules, step) -> None:
    """Adds the paths of a regression tree on ``target`` to ``rules``, and its steps to ``step``."""
    found = _best_split(x[rows], target[rows], grid) if depth else None
    if found is None:
        step[rows] = target[rows].mean() if len(rows) else 0.0
        return
    _, f, t = found
    for below in (True, False):
        child = (*path, (f, below, t))
        rules[tuple(sorted(child))] = None
        _grow(x, target, rows[(x[rows, f] <= t) == below], grid, depth - 1, child, rules, step)


def propose_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float = 0.2) -> list[Rule]:
    grid = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 49))) for f in range(x.shape[1])]
    score, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        step = np.zeros(len(y))
        _grow(x, y - 1 / (1 + np.exp(-score)), np.arange(len(y)), grid, depth, (), rules, step)
        score += rate * 4 * step
    return [Rule(r) for r in rules]


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the mean logistic loss and ``penalty`` times the weights' absolute sum."""
    n, k = r.shape
    full = np.column_stack((np.ones(n), r)).astype(float)
    rate = 4 * n / max(np.linalg.norm(full, 2) ** 2, 1e-12)
    w = np.zeros(k + 1)
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        gradient = full.T @ (1 / (1 + np.exp(-full @ ahead)) - y) / n
        new = ahead - rate * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 40, depth: int = 3, penalty: float = 0.001, id_col: str = "doc_id", label_col: str = "quality") -> Ensemble:
    """Learn from labelled documents; labels must not hold rows that are to be kept from the fit.

    At most about ``max_rows`` labelled rows are used, chosen by a hash of their ids, so what is broadcast for the join
    and what reaches the driver (eleven numbers a row) are bounded; of rows that share an id, the least text stands for
    all, and of labels that share one, the largest. Without labelled rows every score is 0.5; with
    labels of one value, scores are near it.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_k")).agg(F.max(label_col).cast("double").alias("_y"))
    share = min(1_000_000, 1_000_000 * max_rows // max(1, own.count()))
    chosen = own.where(F.pmod(F.xxhash64("_k", F.lit(5)), F.lit(1_000_000)) < share)
    texts = docs.select(F.col(id_col).alias("_k"), F.col("text").alias("text")).join(F.broadcast(chosen), "_k").groupBy("_k").agg(F.min("text").alias("text"), F.first("_y").alias("_y"))
    data = with_statistics(texts).drop("text").orderBy("_k").toPandas()
    if data.empty:
        return Ensemble(0.0, ())
    x, y = data[[f"f_{f}" for f in FEATURES]].to_numpy(float), data["_y"].to_numpy(float)
    rules = propose_rules(x, y, trees, depth)
    if not rules:
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        return Ensemble(float(np.log(p / (1 - p))), ())
    intercept, weights = lasso_logistic(np.column_stack([r.holds(x) for r in rules]), y, penalty)
    return Ensemble(intercept, tuple(Rule(r.tests, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6))


def predict(docs: DataFrame, model: Ensemble, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score (0 to 1) and predicted (1 for a score of ``threshold`` or more), a row for each row.

    Null texts are scored as empty ones; equal texts have equal scores, whatever their ids, which may be null or repeat.
    A very long text is one row like any other; an empty table gives an empty one. Other columns are ignored, whatever their names.
    """
    rows = with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    scored = rows.select(F.col("id").alias(id_col), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
