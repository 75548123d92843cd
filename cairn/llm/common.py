"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of most contracts, in Java's and DuckDB's syntax: no ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder that the cluster names. In local mode, where none is named, take a local one; elsewhere refuse."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "cairn-checkpoints"))


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared checkpoint folder as a table and read again.

    Lineage ends there, as with checkpoint(), but columns are compressed. The table stays until that folder is cleared.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, table: DataFrame, on: list[str], spread: list[str], parts: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key, where a key may hold very many of the rows.

    Rows are dealt over ``parts`` by a hash of the columns ``spread``; a row of the table goes only to the parts that its
    key has, so each task gets about a part's share of a frequent key.
    """
    if parts <= 1:
        return rows.join(table, on, how)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(parts)))
    return rows.join(rows.select(*on, "_part").distinct().join(table, on), [*on, "_part"], how).drop("_part")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents from which nothing may be learned. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def small(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that few of its texts are Python's at a time."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def releasing(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; at its end, memory that is free goes back to the system, since workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def slices(texts: Iterable[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that together hold about ``most`` characters; a longer text stands alone."""
    begin = end = held = 0
    for t in texts:
        if end > begin and held + len(t) > most:
            yield begin, end
            begin, held = end, 0
        held += len(t)
        end += 1
    if end > begin:
        yield begin, end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


_SUM_BASE, _SUM_INVERSE = 0xA0761D6478BD642F, pow(0xA0761D6478BD642F, -1, 1 << 64)
_KEPT_POWERS = 1 << 21
_forward, _backward = powers(1, _SUM_BASE), powers(1, _SUM_INVERSE)


class Sums:
    """Hashes of any range of a sequence of hashes, from running sums of a polynomial modulo 2 ** 64.

    Tables of powers are kept up to a fixed length; longer ones live as long as the sums.
    """

    def __init__(self, items: np.ndarray) -> None:
        global _forward, _backward
        n, forward, self.backward = len(items) + 1, _forward, _backward
        if len(forward) < n:
            forward, self.backward = powers(n, _SUM_BASE), powers(n, _SUM_INVERSE)
            if n <= _KEPT_POWERS:
                _forward, _backward = forward, self.backward
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(items * forward[: n - 1], dtype=np.uint64)))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[begin]) * self.backward[begin] + (end - begin).astype(np.uint64))


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_SALT = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_POWER_TABLE = powers(1 << 12, _BASE)


def hash_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space) of some texts, and each text's number of words.

    The hash of a word depends on its bytes alone: a polynomial over salted bytes, then mixed.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~_SPACES[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.cumsum(lengths + 1)
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    size = ends - starts
    longest = int(size.max())
    table = _POWER_TABLE if longest <= len(_POWER_TABLE) else powers(longest, _BASE)
    code = data[inside]
    if lower:
        code = _LOWER[code]
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(code)) - np.repeat(at, size)
    terms = _BYTE_SALT[code] * table[place]
    return mix64(np.add.reduceat(terms, at) + size.astype(np.uint64)), counts


def gram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of every n consecutive word hashes, by position of the first one (empty when there are fewer)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, 0x2545F4914F6CDD1D ^ salt, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for i in range(n):
        out = (out * factor) ^ (words[i : i + m] + (out >> np.uint64(29)))
    return mix64(out)
