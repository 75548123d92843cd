"""Token counts by a compiled finite-state tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cairn.llm.bpe_transducer import Tokenizer
from cairn.llm.common import releasing, slices, texts_of

_compiled: dict[int, Tokenizer] = {}
SLICE_CHARS = 500_000


def tokenizer(blob: bytes) -> Tokenizer:
    """One compiled tokenizer for each worker process and vocabulary."""
    key = hash(blob)
    if key not in _compiled:
        _compiled[key] = Tokenizer(blob)
    return _compiled[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as the library counts them for a byte-level BPE file, without added tokens.

    ``vocabulary`` is the file's path on the driver; the file (of fixed size) is broadcast. Returns the id, n_bytes
    (UTF-8), n_tokens and over_limit (more than ``limit``), a row for each row. A null text counts as empty: 0, 0,
    false. Null and repeated ids are kept as they are; other columns, of any name, are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in texts_of(batch)]
            parts = [tokenizer(held.value).count_texts(texts[a:b]) for a, b in slices(texts, SLICE_CHARS)]
            n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])
        tokenizer(held.value).forget()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(releasing(count), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
