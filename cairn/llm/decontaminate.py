"""Benchmark decontamination by Wu-Manber search for many word sequences at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ensure_checkpoint_dir, texts_of

#: Bytes of UTF-8 after which words are the runs without spaces: A-Z in lower case, what is no word character a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
NO_HITS = ("CAST(NULL AS ARRAY<INT>) AS hits", "CAST(NULL AS ARRAY<STRING>) AS items")


def match_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class WordWuManber:
    """Search of word lists for patterns of one length: the symbols are words, the blocks are two words (one, for
    patterns of one word). A shift table says how far a window may move on; for blocks that end a pattern, buckets by
    that block and then by first word hold the patterns to compare."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[list[bytes], list[str]]]]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, length), length - end)
            self.buckets.setdefault(words[length - self.block :], {}).setdefault(words[0], []).append((list(words), items))

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, item ids) of each occurrence."""
        length, block, far = self.length, self.block, self.length - self.block + 1
        shift, at, n = self.shift.get, self.length, len(words)
        while at <= n:
            key = (words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],)
            step = shift(key, far)
            if step:
                at += step
                continue
            begin = at - length
            for pattern, items in self.buckets[key].get(words[begin], ()):
                if words[begin:at] == pattern:
                    yield begin, items
            at += 1


def compile_tables(benchmark: list[tuple[str | None, str | None]], window: int) -> list[WordWuManber]:
    """One search for each length of pattern: windows of the items, and whole items that are shorter."""
    patterns: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in benchmark:
        words = match_words(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            owners = patterns.setdefault(m, {}).setdefault(tuple(words[i : i + m]), [])
            if (item or "") not in owners:
                owners.append(item or "")
    return [WordWuManber(p, m) for m, p in sorted(patterns.items())]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Words of each document inside an occurrence of a benchmark window, and the items that such windows come from.

    Returns a row for each row: the id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and
    ``share`` * n_hit >= n_words), hit_positions and hit_items (sorted; empty where there are none). A null text has
    no words; a null item id is written as an empty string; repeated items count once. Columns of other names are
    ignored.

    The benchmark's size is measured first. It is read in blocks of about ``block_chars`` characters, so the tables
    that are broadcast never exceed that; more blocks mean more passes over the documents, with hits carried along.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    state = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text", *NO_HITS)
    kind = docs.schema[id_col].dataType.simpleString()
    if blocks > 1:
        ensure_checkpoint_dir(spark)
    for k in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        tables = spark.sparkContext.broadcast(compile_tables([(r["item"], r["text"]) for r in held.toLocalIterator()], window))
        last = k == blocks - 1

        def scan(batches: Iterator[pa.RecordBatch], tables=tables, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                counts, hits, found = [], [], []
                for text, (old_hits, old_items) in zip(texts_of(batch), before):
                    words = match_words(text)
                    at, names = set(old_hits or ()), set(old_items or ())
                    for table in tables.value:
                        for begin, owners in table.scan(words):
                            at.update(range(begin, begin + table.length))
                            names.update(owners)
                    counts.append(len(words))
                    hits.append(sorted(at))
                    found.append(sorted(names))
                columns = {"id": batch.column(0)} | ({"n_words": pa.array(counts, pa.int64())} if last else {"text": batch.column(1)})
                columns |= {"hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        state = state.mapInArrow(scan, f"id {kind}, {'n_words long' if last else 'text string'}, hits array<int>, items array<string>")
        if not last:
            state = state.checkpoint()
    n_hit = F.size("hits").cast("long")
    return state.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("hits").alias("hit_positions"),
        F.col("items").alias("hit_items"),
    )
