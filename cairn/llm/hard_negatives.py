"""Hard negatives of anchors, found through a vector-approximation file.

Every dimension is cut into cells; a row keeps one byte a dimension beside its exact vector. A table for each anchor
says how little and how much a cell of a dimension can add to the score, so lookups give a lower and an upper bound of
every row's score. Only rows whose bounds may still enter an anchor's positives, or the window of one of them, are
scored exactly.

Anchors and rows meet in blocks: each block of anchors with each block of rows, in one task, so no task holds more than
two blocks, whatever the size of the table, and a frequent label is nothing special. Blocks pass on a few rows an anchor.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import stored

#: Doubles hold integers up to this exactly.
EXACT = 1 << 53


class Cells:
    """Cells of each dimension: their inner edges, and the least and greatest integer that each can hold."""

    def __init__(self, stats: dict[int, tuple[int, int, float, float]], bits: int) -> None:
        marks = [NormalDist().inv_cdf(i / (1 << bits)) for i in range(1, 1 << bits)]
        self.edges, self.least, self.greatest = [], [], []
        for d in range(len(stats)):
            low, high, mean, deviation = stats[d]
            edges = np.unique(np.clip([mean + deviation * z for z in marks], float(low), float(high)).astype(np.int64))
            edges = edges[(edges > low) & (edges <= high)]
            self.edges.append(edges)
            self.least.append(np.concatenate(([low], edges)))
            self.greatest.append(np.concatenate((edges - 1, [high])))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[d], vectors[:, d], side="right") for d in range(vectors.shape[1])], axis=1).astype(np.uint8) if vectors.shape[1] else np.zeros(vectors.shape, np.uint8)

    def bounds(self, anchors: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, rows by anchors."""
        low, high = np.zeros((len(cells), len(anchors))), np.zeros((len(cells), len(anchors)))
        for d in range(cells.shape[1]):
            x, y = np.outer(self.least[d], anchors[:, d]), np.outer(self.greatest[d], anchors[:, d])
            low += np.minimum(x, y)[cells[:, d]]
            high += np.maximum(x, y)[cells[:, d]]
        return low, high


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part: floor(scale * component), exact integers.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Components that 64 bits can't
    hold after scaling become the nearest integer that they can. Other columns are left out.
    """
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(usable)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"))


def approximate(rows: DataFrame, bits: int) -> tuple[DataFrame, Cells]:
    """The approximation file of (row, id, label, v): a byte a dimension. What reaches the driver grows with the dimensions alone."""
    at = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x"), F.max("x"), F.avg("x"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)))
    cells = Cells({d: (low, high, mean, deviation) for d, low, high, mean, deviation in at.collect()}, bits)

    def task(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = [b""] * len(table)
            for dim, where in _by_length(table):
                packed = cells.of(_matrix(table, where, dim))
                for i, code in zip(where.tolist(), packed, strict=True):
                    codes[i] = code.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], names=[*batch.schema.names, "cells"])

    return stored(rows.mapInArrow(task, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, cells binary")), cells


def _by_length(table: pa.Table) -> list[tuple[int, np.ndarray]]:
    lengths = np.fromiter((len(x) for x in table["v"]), np.int64, len(table)) if table["v"].null_count else np.asarray(pc.list_value_length(table["v"]))
    return [(int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths)]


def _matrix(table: pa.Table, where: np.ndarray, dim: int) -> np.ndarray:
    column = table["v"].take(pa.array(where)).combine_chunks()
    return np.asarray(column.flatten(), np.int64).reshape(len(where), dim)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first rows of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    begin = np.searchsorted(group, group)
    return order[np.arange(len(group)) - begin < most]


def _scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact scores of pairs: doubles hold them all, or else Python's integers, of which those beyond 64 bits become the nearest."""
    peak = int(np.abs(rows.astype(object)).max(initial=0)) * int(np.abs(anchors.astype(object)).max(initial=0)) * max(1, rows.shape[1])
    if peak < EXACT:
        return np.einsum("ij,ij->i", rows.astype(np.float64), anchors.astype(np.float64)).astype(np.int64)
    most = (1 << 63) - 1
    return np.array([max(-most, min(most, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for x, y in zip(rows, anchors, strict=True)], np.int64)


def _search(cells: Cells, wanted: Callable, schema: pa.Schema, anchors_at_once: int = 64, rows_at_once: int = 2048) -> Callable:
    """A function of two blocks. ``wanted`` says which rows may enter an anchor's result, and reduces the exactly scored ones."""

    def task(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        by_length = dict(_by_length(rows)) if len(rows) else {}
        for dim, at in _by_length(anchors) if len(anchors) else []:
            if (there := by_length.get(dim)) is None:
                continue
            vectors, codes = _matrix(rows, there, dim), np.frombuffer(b"".join(rows["cells"].take(pa.array(there)).to_pylist()), np.uint8).reshape(len(there), dim)
            number, ids, labels = (np.asarray(rows[c].take(pa.array(there))) for c in ("row", "id", "label"))
            for a in range(0, len(at), anchors_at_once):
                part = anchors.take(pa.array(at[a : a + anchors_at_once]))
                query = _matrix(part, np.arange(len(part)), dim)
                rule, found = wanted(part), []
                exact = dim * int(np.abs(query.astype(object)).max(initial=0)) * int(np.abs(vectors.astype(object)).max(initial=0)) < EXACT
                for r in range(0, len(there), rows_at_once):
                    span = slice(r, r + rows_at_once)
                    if exact:
                        low, high = cells.bounds(query.astype(np.float64), codes[span])
                    else:  # bounds would be rounded: every row may enter
                        low, high = np.full((len(codes[span]), len(part)), -np.inf), np.full((len(codes[span]), len(part)), np.inf)
                    x, y = np.nonzero(rule.may_enter(low, high, number[span], labels[span]))
                    found.append((x + r, y, _scores(vectors[x + r], query[y])))
                x, y, score = (np.concatenate(c) for c in zip(*found, strict=True))
                out.append(rule.reduce(y, ids[x], score))
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return task


class _Positives:
    """The first rows of an anchor's own label."""

    def __init__(self, anchors: pa.Table, most: int) -> None:
        self.row, self.label, self.most = np.asarray(anchors["row"]), np.asarray(anchors["label"]), most

    def may_enter(self, low: np.ndarray, high: np.ndarray, row: np.ndarray, label: np.ndarray) -> np.ndarray:
        own = (label[:, None] == self.label[None, :]) & (row[:, None] != self.row[None, :])
        sure = np.where(own, low, -np.inf)
        least = np.partition(sure, len(sure) - self.most, axis=0)[len(sure) - self.most] if len(sure) > self.most else -np.inf
        return own & (high >= least)

    def reduce(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
        best = _first(anchor, score, ids, self.most)
        return pa.table({"row": self.row[anchor[best]], "other_id": ids[best], "score": score[best]})


class _Negatives:
    """The first rows of other labels in the window below each positive's score."""

    def __init__(self, anchors: pa.Table, most: int, share: int) -> None:
        self.row, self.label, self.most, self.share = np.asarray(anchors["row"]), np.asarray(anchors["label"]), most, share
        scores = anchors["positives"].to_pylist()
        self.windows = [[p["score"] for p in x] for x in scores]
        self.places = max(map(len, self.windows), default=0)

    def _window(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score, one a column; an empty window where an anchor has no such positive."""
        top = np.array([float(w[k]) if k < len(w) else -np.inf for w in self.windows])
        return np.where(np.isfinite(top), top * self.share / 100, np.inf), top

    def may_enter(self, low: np.ndarray, high: np.ndarray, row: np.ndarray, label: np.ndarray) -> np.ndarray:
        other, out = label[:, None] != self.label[None, :], np.zeros(low.shape, bool)
        for k in range(self.places):
            bottom, top = self._window(k)
            slack = 1e-12 * np.abs(np.where(np.isfinite(top), top, 0))  # windows are judged exactly later
            inside = np.where(other & (low >= bottom + slack) & (high <= top - slack), low, -np.inf)
            least = np.partition(inside, len(inside) - self.most, axis=0)[len(inside) - self.most] if len(inside) > self.most else -np.inf
            out |= other & (high >= np.maximum(bottom - slack, least)) & (low <= top + slack)
        return out

    def reduce(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
        out = []
        for k in range(self.places):
            top = np.array([w[k] if k < len(w) else 0 for w in self.windows], np.int64)[anchor]
            there = np.array([k < len(w) for w in self.windows], bool)[anchor]
            if max(np.abs(top).max(initial=0), np.abs(score).max(initial=0)) >= EXACT:  # products may pass 64 bits
                top, given = top.astype(object), score.astype(object)
            else:
                given = score
            at = np.flatnonzero(there & (self.share * top <= 100 * given).astype(bool) & (100 * given <= 100 * top).astype(bool))
            best = at[_first(anchor[at], score[at], ids[at], self.most)]
            out.append(pa.table({"row": self.row[anchor[best]], "place": np.full(len(best), k + 1, np.int32), "other_id": ids[best], "score": score[best]}))
        return pa.concat_tables(out) if out else pa.schema([("row", pa.int64()), ("place", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())]).empty_table()


def _in_blocks(anchors: DataFrame, rows: DataFrame, task: Callable, schema: str, anchor_blocks: int, row_blocks: int) -> DataFrame:
    """``task`` of every block of anchors with every block of rows. Blocks hold about as many rows each, by a hash of the row's number."""
    a = anchors.withColumn("_q", F.pmod(F.xxhash64("row"), F.lit(anchor_blocks))).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    b = rows.withColumn("_r", F.pmod(F.xxhash64("row"), F.lit(row_blocks))).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(anchor_blocks - 1).cast("long"))))
    return a.groupBy("_q", "_r").cogroup(b.groupBy("_q", "_r")).applyInArrow(task, schema)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: int = 80, bits: int = 6, anchors_per_block: int = 4096, rows_per_block: int = 4096) -> DataFrame:
    """For each anchor and each of its positives, the hardest rows of other labels that aren't harder than the positive.

    ``vectors`` has (id, label, v) as of ``integer_vectors``; ``is_anchor`` is a condition on them. An anchor's positives
    are the first other rows of its label; a negative's score lies between ``share`` hundredths of the positive's score
    and that score. First means a higher inner product, then a smaller id. Rows that share an id are rows of their own;
    an anchor is compared with rows of its own length of vector only. A positive of a score below 0 has an empty window.
    Scores that 64 bits can't hold become the nearest number that they can, and tie there. Long vectors cost in proportion.
    An empty table gives an empty result.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. The search is exact, so its recall
    is 1: every row is in the approximation file, and each is compared with every anchor through its bounds.
    """
    rows, cells = approximate(stored(vectors.withColumn("row", F.monotonically_increasing_id())), bits)
    anchors = rows.where(is_anchor).select("row", "id", "label", "v")
    blocks = tuple(max(1, -(-n // size)) for n, size in ((anchors.count(), anchors_per_block), (rows.count(), rows_per_block)))
    found = _in_blocks(anchors, rows, _search(cells, lambda a: _Positives(a, positives), pa.schema([("row", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())])), "row long, other_id long, score long", *blocks)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "other_id")
    found = stored(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives))
    listed = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("positives"))
    windows = stored(anchors.join(listed, "row"))
    near = _in_blocks(windows, rows, _search(cells, lambda a: _Negatives(a, negatives, share), pa.schema([("row", pa.int64()), ("place", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())])), "row long, place int, other_id long, score long", *blocks)
    hardest = Window.partitionBy("row", "place").orderBy(F.desc("score"), "other_id")
    near = near.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= negatives).select("row", "place", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("row", "place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return near.join(named, ["row", "place"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
