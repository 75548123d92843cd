"""Substring dedup: documents are parsed into factors that occur elsewhere, and long factors are removed.

A relative parsing needs the places of the references that may continue a factor. Here all documents are references.
Each is cut into blocks by anchors: of the k-word grams in a window of 35 words, the one with the least hash. A block
is the run of windows that share an anchor; equal windows have equal anchors, so they meet by its hash. A block whose
words occur at another place continues a factor as a whole. Where an anchor recurs and the words around it differ,
which is at the boundaries of factors, the block's single windows are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Sums, gram_hashes, hash_words, mix64, slices, stored, texts_of

GRAM = 8
SLICE_CHARS = 500_000
HOT_SHARE = 1000
SALTS = 16


def _most_frequent(counted: DataFrame, on: list[str]) -> DataFrame:
    """The keys of (on, c) that hold more than a thousandth of all counted rows: fewer than a thousand, so they can be broadcast."""
    total = counted.agg(F.sum("c")).first()[0] or 0
    return counted.where(F.col("c") * HOT_SHARE > total).select(*on, F.lit(True).alias("hot"))


def _salted(rows: DataFrame) -> DataFrame:
    """Rows with a salt: rows of hot keys are dealt over several tasks by their place, others have salt 0."""
    return rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key", "lo"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))


def _every_salt(keys: DataFrame) -> DataFrame:
    """Keys with each salt that their rows may have."""
    return keys.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))


def _marked(rows: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Rows with ``hot``, whether their key is one of those (null counts as no)."""
    return rows.join(F.broadcast(hot), on, "left")


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` consecutive values, the first one of equals."""
    at, span = np.arange(len(values), dtype=np.int64), 1
    held = values
    while span < width:
        step = min(span, width - span)
        right = held[step:] < held[: len(held) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        held = values[at]
        span += step
    return at


def blocks(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Blocks of several documents: (document, begin in it, windows, anchor hash, hash of its words), and its begin in ``words``."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    grams = gram_hashes(words, GRAM, 3)
    anchor = _least(grams, window - GRAM + 1)
    ends = np.cumsum(counts)
    document = np.repeat(np.arange(len(counts)), counts)[: len(anchor)]
    inside = np.arange(len(anchor)) + window <= ends[document]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(first)
    starts = np.flatnonzero(inside)
    n = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
    doc = document[begin]
    content = Sums(words).of(begin, begin + n + window - 1)
    content = mix64(content ^ ((anchor[begin] - begin).astype(np.uint64) << np.uint64(40)) ^ n.astype(np.uint64))
    return doc, begin - (ends - counts)[doc], n, grams[anchor[begin]], content, begin


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each word that a window of ``window`` words covers whose words also start anywhere else.

    Words are runs without ASCII white space; windows are judged on the input. Returns a row for each row: the id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, if asked for, kept_text. A null text
    has no words. Null and repeated ids are rows like any other; other columns are ignored, whatever their names.
    Equality is that of two independent 64-bit hashes.
    The input is read several times and must give its rows in the same order each time, as a table does. A very long
    text is one row of one task; an anchor or a block that very many rows share is dealt over several tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), [(t or "").encode() for t in texts_of(batch)]
            for a, b in slices(texts, SLICE_CHARS):
                doc, lo, n, anchor, content, _ = blocks(*hash_words(texts[a:b]), window)
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][doc]), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), _signed(anchor), _signed(content)], ["key", "lo", "n", "anchor", "content"])

    found = keyed.select("key", "text").mapInArrow(cut, "key long, lo int, n int, anchor long, content long")
    by_anchor = found.groupBy("anchor").agg(F.count("*").alias("c"), F.min("content").alias("least"), F.max("content").alias("most")).where("c > 1")
    by_anchor = stored(by_anchor.select("anchor", "c", (F.col("least") != F.col("most")).alias("mixed")))
    hot = _most_frequent(by_anchor, ["anchor"])
    recurring = _every_salt(_marked(by_anchor.select("anchor", "mixed"), hot, ["anchor"])).drop("hot")
    # Read several times, so it is written once, instead of parsing texts again.
    shared = stored(_salted(_marked(found, hot, ["anchor"])).join(recurring, ["anchor", "salt"]).drop("salt"))
    whole = shared.where("NOT mixed").select("key", "lo", "n")
    mixed = shared.where("mixed")
    pair = ["anchor", "content"]
    variants = stored(mixed.groupBy(*pair).agg(F.count("*").alias("c"), F.min(F.struct("key", "lo", "n")).alias("r"), F.first("hot").alias("hot")))
    frequent = _most_frequent(variants.where("c > 1"), pair)
    doubled = _every_salt(_marked(variants.where("c > 1").select(*pair), frequent, pair)).drop("hot")
    again = _salted(_marked(mixed.drop("hot"), frequent, pair)).join(doubled, [*pair, "salt"], "left_semi").select("key", "lo", "n")
    # One occurrence stands for each variant of a block; the windows of variants that occur once are still to be judged.
    chosen = variants.select("r.key", F.struct("r.lo", "r.n", "anchor", (F.col("c") == 1).alias("once"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("block")).groupBy("key").agg(F.collect_list("block").alias("blocks"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in texts_of(batch)]
            every = batch.column(batch.schema.get_field_index("blocks"))
            for a, b in slices(texts, SLICE_CHARS):
                words, counts = hash_words(texts[a:b])
                flat, owner = every.slice(a, b - a).flatten(), np.repeat(np.arange(b - a), every.slice(a, b - a).value_lengths().to_numpy())
                lo, n, anchor, once, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                of = np.repeat(np.arange(len(lo)), n)
                place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = lo[of] + place + (np.cumsum(counts) - counts)[owner[of]]
                content = Sums(words).of(start, start + window)
                keys = batch.column(0).to_numpy()[a:b][owner[of]]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array((lo[of] + place).astype(np.int32)), pa.array(anchor[of]), _signed(content), pa.array(once[of]), pa.array(hot[of])], ["key", "lo", "anchor", "content", "once", "hot"])

    # Nothing is written between here and the last join, and the same columns are joined: so texts are shuffled once for both.
    single = keyed.join(chosen, "key").select("key", "id", "text", "blocks").mapInArrow(windows, "key long, lo int, anchor long, content long, once boolean, hot boolean")
    repeated = single.groupBy(*pair).agg(F.count("*").alias("c"), F.max("once").alias("any"), F.first("hot").alias("hot")).where("c > 1 AND any")
    edges = _salted(single.where("once")).join(_every_salt(repeated).select(*pair, "salt"), [*pair, "salt"], "left_semi").select("key", "lo", F.lit(1).alias("n"))
    spans = whole.unionByName(again).unionByName(edges).groupBy("key").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(texts_of(batch), batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                words = (text or "").encode().split()
                if spans:
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, [s["lo"] for s in spans], 1)
                    np.add.at(edge, [s["lo"] + s["n"] + window - 1 for s in spans], -1)
                    left = np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()
                    kept = [words[i] for i in left]
                else:
                    kept = words
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = keyed.join(spans, "key", "left").select("key", "id", "text", "spans").mapInArrow(keep, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    out = out.withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept_text")
