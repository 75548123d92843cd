"""Best-fit packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ensure_checkpoint_dir, releasing, slices, texts_of
from cairn.llm.token_counts import SLICE_CHARS, read_vocabulary, tokenizer

PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first one, which may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document's ids and ``end_id``: id, piece, start, length, crc32 of the ids."""
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, of = [t or "" for t in texts_of(batch)], [], []
            for a, b in slices(texts, SLICE_CHARS):
                for i, ids in enumerate(tokenizer(held.value).id_texts(texts[a:b]), a):
                    ids += end
                    for k, (s, n) in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        of.append(i)
                        rows.append((k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], ["id", "piece", "start", "length", "ids_crc32"])
        tokenizer(held.value).forget()

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(releasing(cut), f"id {kind}, {PIECE_SCHEMA}")


def sum_of_squares(lengths: np.ndarray, capacity: int, reuse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item, placed in turn.

    Each item goes where the sum, over the gaps 1 .. capacity - 1, of the squared number of open bins with that gap
    becomes smallest; of equal places, the fullest bin. With ``reuse``, a new bin is opened only for what fits nowhere.
    Only the counts by gap matter, and bins of a gap are a stack.
    """
    counts = np.zeros(capacity + 1, np.int64)  # counts[gap] of open bins; a full or an unopened bin counts nothing
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        # Moving a bin from gap g to g - n changes the sum by 2 (counts[g - n] - counts[g] + 1), without the terms of
        # gap 0 and of a new bin. The last place stands for a new bin.
        after = counts[: capacity + 1 - n]
        change = 2 * (after - counts[n:]) + 2
        change[0] = 1 - 2 * counts[n]
        change[-1] = 2 * after[-1] + 1 if n < capacity else 0
        change[:-1][counts[n:-1] == 0] = np.iinfo(np.int64).max
        if reuse:
            change[-1] = np.iinfo(np.int64).max - 1
        gap = n + int(change.argmin())
        if gap == capacity:
            to, opened = opened, opened + 1
        else:
            to = stacks[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = to, capacity - gap
        if gap > n:
            stacks[gap - n].append(to)
            counts[gap - n] += 1
    return bins, offsets


def best_of_orders(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best packing of three: as given, longest first, and longest first with new bins only where nothing fits."""
    order, best = np.argsort(-lengths, kind="stable"), None
    for at, reuse in ((np.arange(len(lengths)), False), (order, False), (order, True)):
        found = sum_of_squares(lengths[at], capacity, reuse)
        n = int(found[0].max()) + 1 if len(lengths) else 0
        if best is None or n < best[0]:
            bins, offsets = np.empty_like(found[0]), np.empty_like(found[1])
            bins[at], offsets[at] = found
            best = n, bins, offsets
    return best[1], best[2]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, shard_items: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; a null text counts as empty. Longer ones are cut into full pieces, of which
    the first may be shorter. Returns per piece: the id, piece, start, length, ids_crc32, sequence_id, offset. Full
    pieces are sequences of their own. The others, one a document at most, are dealt by a hash into shards of about
    ``shard_items``, each packed by the sum-of-squares rule, so no task holds more however large the input; a shard
    leaves a few open sequences among thousands. Null or repeated ids are packed like any other row.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = tokenized_pieces(docs, vocabulary, end_id, capacity, id_col, text_col).checkpoint()
    short = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-short.count() // shard_items))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["crc", "start"], kind="stable", ignore_index=True)
        bins, offsets = best_of_orders(rows["length"].to_numpy(), capacity)
        return rows.drop(columns=["shard", "crc"]).assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    # The number of the partition spreads rows of one id; it is the same when a task runs again.
    dealt = short.withColumn("shard", F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(shards))).withColumn("crc", F.xxhash64("id"))
    packed = dealt.groupBy("shard").applyInPandas(place, f"id {kind}, {PIECE_SCHEMA}, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full).withColumnRenamed("id", id_col)
