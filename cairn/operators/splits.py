"""Split targets, assignment of groups by what labels lack, repair of sizes, manifests and their audit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.relate import numbered

#: The splits and the shares of the first two.
SPLITS, SHARES = ("train", "val", "test"), (0.8, 0.1)


def targets(n: Column) -> dict[str, Column]:
    """Half-even 80 / 10 / rest."""
    train, val = (F.bround(n * share).cast("long") for share in SHARES)
    return {"train": train, "val": val, "test": n - train - val}


def quotas(total: np.ndarray | int) -> np.ndarray:
    """The same for an array: a row of three numbers for each total."""
    total = np.asarray(total)
    head = np.rint(np.multiply.outer(total, SHARES)).astype(np.int64)
    return np.concatenate((head, (total - head.sum(axis=-1))[..., None]), axis=-1)


def apportion(n: int, open_: np.ndarray, then: np.ndarray) -> np.ndarray:
    """``n`` things dealt in proportion to what is open, by largest remainders; ``then`` decides between equal ones, then the order."""
    open_ = np.maximum(open_, 0)
    ideal = n * (open_ / open_.sum() if open_.sum() else np.append(SHARES, 1 - sum(SHARES)))
    out = np.floor(ideal + 1e-9).astype(np.int64)
    rest = np.lexsort((np.arange(len(out)), -then, -np.round(ideal - out, 9)))
    out[rest[: n - out.sum()]] += 1
    return out


def deal(kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many groups of each kind go to each split; row k of ``kinds`` has the labels of a kind, as 0 and 1.

    The label of which fewest groups are left comes first; its kinds, those with most labels first, are apportioned to
    what its quotas still lack, and remainders go where their other labels lack most. Kinds without labels fill the splits.
    """
    kinds = kinds.astype(bool)
    out, lack, room = np.zeros((len(sizes), len(SPLITS)), np.int64), quotas(sizes @ kinds.astype(np.int64)), quotas(sizes.sum())
    left = np.ones(len(sizes), bool)

    def place(k: int, open_: np.ndarray) -> None:
        others = lack[kinds[k]].sum(axis=0) if kinds[k].any() else room
        out[k] = apportion(int(sizes[k]), open_, others)
        lack[kinds[k]] -= out[k]
        room[:] -= out[k]
        left[k] = False

    while (counts := (sizes * left) @ kinds.astype(np.int64)).any():
        label = int(np.where(counts > 0, counts, counts.max() + 1).argmin())
        for k in sorted(np.flatnonzero(left & kinds[:, label]), key=lambda k: (-kinds[k].sum(), k)):
            place(k, lack[label])
    for k in np.flatnonzero(left):
        place(k, room)
    # What rounding left over: moves of one group, as long as one brings labels and sizes nearer to their quotas.
    counted = np.column_stack((kinds, np.ones(len(sizes), bool))).astype(np.int64)
    off = counted.T @ out - quotas(sizes @ counted)
    while len(sizes):
        change = 2 * (counted @ off)[:, None, :] - 2 * (counted @ off)[:, :, None] + 2 * counted.sum(axis=1)[:, None, None]
        change[(out == 0)[:, :, None] | np.eye(len(SPLITS), dtype=bool)[None]] = 0
        k, a, b = np.unravel_index(change.argmin(), change.shape)
        if change[k, a, b] >= 0:
            break
        out[k, a] -= 1
        out[k, b] += 1
        off[:, a] -= counted[k]
        off[:, b] += counted[k]
    return out


def grouped_split(groups: DataFrame) -> DataFrame:
    """(id, split) of groups (id, labels), so that splits hold their shares of every label; within a kind by a hash of the id.

    Groups of equal labels are one kind. The driver sees each kind with its number of groups (a few bytes for a kind) and
    says how many of them each split gets; groups find their split by their place within the kind. Without labels (or with
    null ones) a group is of the kind that has none.
    """
    spark = groups.sparkSession
    own = F.array_sort(F.array_distinct(F.filter(F.coalesce("labels", F.array().cast(groups.schema["labels"].dataType)), lambda x: x.isNotNull())))
    kind = groups.select("id", own.alias("labels"), F.sha2(F.concat(F.lit("42:"), F.col("id").cast("string")), 256).alias("rank"))
    sizes = sorted((tuple(r["labels"]), r["n"]) for r in kind.groupBy("labels").agg(F.count("*").alias("n")).collect())
    names = sorted({c for labels, _ in sizes for c in labels})
    table = np.array([[c in labels for c in names] for labels, _ in sizes], np.int64).reshape(len(sizes), len(names))
    ends = np.cumsum(deal(table, np.array([n for _, n in sizes], np.int64)), axis=1).tolist()
    dealt = spark.createDataFrame([(list(labels), *e[:2]) for (labels, _), e in zip(sizes, ends, strict=True)], f"labels {groups.schema['labels'].dataType.simpleString()}, a long, b long")
    placed = numbered(kind, ["labels"], ["rank", "id"], "place").join(dealt, "labels")
    return placed.select("id", F.when(F.col("place") < F.col("a"), SPLITS[0]).when(F.col("place") < F.col("b"), SPLITS[1]).otherwise(SPLITS[2]).alias("split"))


def repair_moves(counts: np.ndarray, kinds: np.ndarray, heads: list[list[list]], wanted: np.ndarray) -> list[tuple]:
    """(id, from, to) of the moves that give each split its wanted number of rows.

    ``counts`` has the rows of each kind in each split, ``heads`` their first ids. A move takes a row from a split with too
    many to one with too few: that after which the labels of all splits are nearest to their shares (least squares); of
    equal moves the one of the row with fewest labels, then of the least id, then of the first splits by name.
    """
    share = np.outer(wanted / wanted.sum(), counts.sum(axis=1) @ kinds)
    held, size = counts.T @ kinds.astype(float), counts.sum(axis=0)
    taken, out = np.zeros(counts.shape, np.int64), []
    while (size != wanted).any():
        off, best = held - share, None
        for a in np.flatnonzero(size > wanted):
            for b in np.flatnonzero(size < wanted):
                # What the squares change by when a kind's labels leave a and come to b.
                gain = np.round((kinds * (2 * (off[b] - off[a]) + 2)).sum(axis=1), 9)
                for k in np.flatnonzero(counts[:, a] > taken[:, a]):
                    key = (gain[k], kinds[k].sum(), heads[k][a][taken[k, a]], SPLITS[a], SPLITS[b])
                    if best is None or key < best[0]:
                        best = key, k, a, b
        if best is None:
            raise ValueError("the wanted sizes don't sum to the number of rows")
        key, k, a, b = best
        out.append((key[2], SPLITS[a], SPLITS[b]))
        taken[k, a] += 1
        held[a] -= kinds[k]
        held[b] += kinds[k]
        size[a] -= 1
        size[b] += 1
    return out


def repair_sizes(assigned: DataFrame, wanted: dict[str, int], most_moves: int = 100_000) -> DataFrame:
    """(id, split, moved_from) of rows (id, labels, split) after moves that give each split exactly its wanted number of rows.

    A step looks at every kind of rows (equal labels) in every split, not at every row; the driver holds the kinds' counts
    and, of each kind, as many first ids as its split has rows too many. Rows move at most once. Repairs of more than
    ``most_moves`` rows are refused: they aren't rounding, and ``grouped_split`` deals any number.
    """
    spark = assigned.sparkSession
    rows = assigned.select("id", F.array_sort(F.array_distinct(F.filter("labels", lambda x: x.isNotNull()))).alias("labels"), "split")
    counted = rows.groupBy("labels", "split").agg(F.count("*").alias("n")).collect()
    sizes = {s: sum(r["n"] for r in counted if r["split"] == s) for s in SPLITS}
    over = {s: max(0, sizes[s] - wanted[s]) for s in SPLITS}
    if sum(over.values()) > most_moves:
        raise ValueError(f"{sum(over.values())} rows would have to move; at most {most_moves} may")
    few = F.row_number().over(W.partitionBy("labels", "split").orderBy("id"))
    limit = F.coalesce(*(F.when(F.col("split") == s, F.lit(n)) for s, n in over.items()))
    # Rank limits of whole numbers cut in every task before rows meet.
    first = rows.withColumn("_i", few).where(F.col("_i") <= max(over.values())).where(F.col("_i") <= limit).collect() if any(over.values()) else []
    names = sorted({tuple(r["labels"]) for r in counted})
    every = sorted({c for labels in names for c in labels})
    kinds = np.array([[c in labels for c in every] for labels in names], np.int64).reshape(len(names), len(every))
    counts, heads = np.zeros((len(names), len(SPLITS)), np.int64), [[[] for _ in SPLITS] for _ in names]
    place = {labels: i for i, labels in enumerate(names)}
    for r in counted:
        counts[place[tuple(r["labels"])], SPLITS.index(r["split"])] = r["n"]
    for r in sorted(first, key=lambda r: r["_i"]):
        heads[place[tuple(r["labels"])]][SPLITS.index(r["split"])].append(r["id"])
    moves = repair_moves(counts, kinds, heads, np.array([wanted[s] for s in SPLITS]))
    moved = spark.createDataFrame(moves, f"id {assigned.schema['id'].dataType.simpleString()}, moved_from string, _to string")
    return rows.join(moved, "id", "left").select("id", F.coalesce("_to", "split").alias("split"), "moved_from")


def manifest(original: DataFrame, balanced: DataFrame, assigned: DataFrame, source: str) -> DataFrame:
    """Rows of the splits: train takes the balanced rows, val and test the original ones, by the split of their source."""
    held_out = original.join(assigned.where("split <> 'train'"), source)
    return balanced.join(assigned.where("split = 'train'"), source).unionByName(held_out)


def source_manifest(rows: DataFrame, assigned: DataFrame, source: str, label: str, classes: list, seed: int) -> DataFrame:
    """(source, split, <label>_<class>_present as 0 or 1.., random_seed): a row a source; one without a split has a null."""
    flags = [F.max(F.coalesce(F.col(label) == c, F.lit(False)).cast("int")).alias(f"{label}_{c}_present") for c in classes]
    return rows.where(F.col(source).isNotNull()).groupBy(source).agg(*flags).join(assigned, source, "left").select(source, "split", *(f"{label}_{c}_present" for c in classes), F.lit(seed).alias("random_seed"))


def report(rows: DataFrame, source: str, label: str, split: str = "split") -> DataFrame:
    """(split, rows, sources, classes, shared) of manifests as one table: different sources, a map of rows by class (as text; a
    null is blank), and how many of a split's sources another split holds too."""
    classes = rows.groupBy(split, F.coalesce(F.col(label).cast("string"), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    counts = classes.groupBy(split).agg(F.sum("n").alias("rows"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("classes"))
    held = rows.where(F.col(source).isNotNull() & F.col(split).isNotNull()).select(split, F.col(source).alias("_s")).distinct()
    several = held.groupBy("_s").agg((F.count("*") > 1).alias("_several"))
    sources = held.join(several, "_s").groupBy(split).agg(F.count("*").alias("sources"), F.count_if("_several").alias("shared"))
    out = counts.join(sources, split, "left")
    return out.select(split, "rows", F.coalesce("sources", F.lit(0)).alias("sources"), "classes", F.coalesce("shared", F.lit(0)).alias("shared"))


def audit(assigned: DataFrame, label: str) -> DataFrame:
    """(label, split, n, target, difference_from_target) for each label and split, zeros included."""
    total = assigned.groupBy(label).agg(F.count("*").alias("total"), *(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS))
    wanted = targets(F.col("total"))
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), F.col(f"n_{s}").alias("n"), wanted[s].alias("target")) for s in SPLITS)))
    return total.select(label, rows.alias("r")).select(label, "r.*").withColumn("difference_from_target", F.col("n") - F.col("target"))
