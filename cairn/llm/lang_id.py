"""Language identification by known words, with a backoff to ever shorter character n-grams for unseen ones."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import releasing, small, stored, texts_of

_WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Counts that a task holds before it passes them on.
MOST_COUNTS = 150_000


def letter_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with marks for its ends; for one character, without the marks."""
    if n == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class WordBackoff:
    """Log frequencies by language of words (``tables[0]``) and of n-grams (``tables[n]``): the row of each in a matrix."""

    def __init__(self, langs: list[str], tables: list[tuple[dict[str, int], np.ndarray]], most_words: int = 200_000) -> None:
        self.langs, self.tables, self.most = langs, tables, most_words
        self.rows: dict[str, int] = {}
        self.matrix = np.zeros((most_words, len(langs)), np.float32)

    def vectors(self, words: list[str]) -> np.ndarray:
        """The row of each known word; of others, the mean of the rows of their longest n-grams of which any is known, or 0."""
        out, left, at = np.zeros((len(words), len(self.langs)), np.float32), words, np.arange(len(words))
        for n in (0, *range(LONGEST, 0, -1)):
            rows, matrix = self.tables[n]
            found, sizes = [], []
            for w in left:
                hits = [i for g in (grams(w, n) if n else (w,)) if (i := rows.get(g)) is not None]
                found += hits
                sizes.append(len(hits))
            size = np.array(sizes, np.int64)
            some = size > 0
            if len(found):
                begin = (np.cumsum(size) - size)[some]
                out[at[some]] = np.add.reduceat(matrix.take(found, axis=0), begin, axis=0) / size[some, None].astype(np.float32)
            left, at = [w for w, c in zip(left, sizes) if not c], at[~some]
            if not left:
                break
        return out

    def _sum(self, words: list[str]) -> np.ndarray:
        """The sum of the words' vectors. Those of words met lately are kept, in a table of fixed size."""
        total = np.zeros(len(self.langs))
        for a in range(0, len(words), self.most):
            part = words[a : a + self.most]
            if len(self.rows) + len(part) > self.most:
                self.rows.clear()
            fresh = [w for w in dict.fromkeys(part) if w not in self.rows]
            if fresh:
                begin = len(self.rows)
                self.rows.update(zip(fresh, range(begin, begin + len(fresh))))
                self.matrix[begin : begin + len(fresh)] = self.vectors(fresh)
            total += self.matrix.take(list(map(self.rows.__getitem__, part)), axis=0).sum(axis=0, dtype=float)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share of the likelihood; ``und``, 0 without any letter."""
        words = letter_words(text or "")
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        total = self._sum(words)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def training_rows(docs: DataFrame, rows_per_lang: int, lang_col: str, text_col: str, key_col: str) -> DataFrame:
    """(lang, text) of about ``rows_per_lang`` documents of each language, chosen by a hash of the key."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key_col).alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    share = F.least(F.lit(1_000_000), F.floor(F.lit(1_000_000 * rows_per_lang) / F.col("count")))
    wanted = labelled.groupBy("lang").count().select("lang", share.alias("share"))
    return labelled.join(F.broadcast(wanted), "lang").where(F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1_000_000)) < F.col("share")).select("lang", "text")


def fit(docs: DataFrame, rows_per_lang: int = 2_000, most_entries: int = 30_000, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id") -> WordBackoff:
    """Learn from labelled documents: a sample of about ``rows_per_lang`` whole texts of each language, by a hash.

    Of words and of each length of n-gram, the ``most_entries`` most frequent ones that occur twice or more are kept,
    so the model that is broadcast has a bound. Without labelled rows it has no language and predicts ``und``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in ((lang, text) for part in small(batch) for lang, text in zip(part.column(0).to_pylist(), texts_of(part))):
                if len(found) > MOST_COUNTS:
                    yield counted(found)
                    found = Counter()
                for w, c in Counter(letter_words(text)).items():
                    found[lang, 0, w] += c
                    for n in range(1, LONGEST + 1):
                        for g in grams(w, n):
                            found[lang, n, g] += c
            yield counted(found)

    def counted(found: Counter) -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["lang", "n", "gram", "c"])

    rows = training_rows(docs, rows_per_lang, lang_col, text_col, key_col)
    counts = rows.mapInArrow(releasing(count), "lang string, n int, gram string, c long").groupBy("n", "gram", "lang").agg(F.sum("c").alias("c"))
    entries = counts.groupBy("n", "gram").agg(F.sum("c").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by")).where("total >= 2")
    entries = stored(entries)  # read once for each length; texts are counted once
    top = None
    for n in range(LONGEST + 1):
        one = entries.where(F.col("n") == n).orderBy(F.desc("total"), "gram").limit(most_entries)
        top = one if top is None else top.unionByName(one)
    found = top.collect()
    langs = sorted({lang for r in found for lang in r["by"]})
    tables: list[tuple[dict[str, int], np.ndarray]] = []
    for n in range(LONGEST + 1):
        own = [r for r in found if r["n"] == n]
        table = np.array([[r["by"].get(x, 0) for x in langs] for r in own], float).reshape(len(own), len(langs)) + 0.5
        table = np.log(table / table.sum(axis=0, keepdims=True)) if len(own) else table
        tables.append(({r["gram"]: i for i, r in enumerate(own)}, table.astype(np.float32)))
    return WordBackoff(langs, tables)


def predict(docs: DataFrame, model: WordBackoff, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: the id, lang_pred, score (0 to 1), a row for each row.

    ``und`` with score 0 for null texts and texts without a letter. Of equally likely languages, the first by name is
    taken, with their equal share as its score. Very long texts are summed in parts, so they cost memory for their words
    only. Null and repeated ids are rows like any other; an empty table gives an empty one. Other columns are ignored,
    whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordBackoff(*held.value)
        for batch in batches:
            out = [own.predict(t) for part in small(batch) for t in texts_of(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(releasing(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
