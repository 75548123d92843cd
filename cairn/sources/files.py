"""Files of a folder as rows, listed in tasks, and texts in an encoding that isn't known beforehand."""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, kind string, size long, head binary, modified timestamp"
#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp950")


class _Folder(InputPartition):
    def __init__(self, folder: str, deep: bool) -> None:
        self.folder, self.deep = folder, deep


class FileTree(DataSource):
    """``spark.read.format("file_tree").load(root)``: every file and folder below ``root``, also files without bytes.

    Columns: path (from the root), kind (file or folder), size, head (the first bytes, as many as option ``head``, 8 if
    it isn't set), modified. ``root`` is a path or an address that pyarrow's file systems open. The driver names folders
    only until there are enough parts for tasks (option ``parts``, 64 if it isn't set); files are listed in tasks.
    A root that doesn't exist has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def _opened(root: str):
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))


class _TreeReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root, self.head, self.parts = options["path"], int(options.get("head", 8)), int(options.get("parts", 64))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _opened(self.root)
        if system.get_file_info(root).type != fs.FileType.Directory:
            return [_Folder("", False)]
        whole, level = [], [root]
        while level and len(whole) + len(level) < self.parts:
            below = [i.path for folder in level for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.Directory]
            if not below:
                break
            whole, level = whole + level, below
        # Folders that were opened give their own entries; those not opened yet, all that is below them.
        return [_Folder(f, False) for f in whole] + [_Folder(f, True) for f in level]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        from pyarrow import fs

        system, root = _opened(self.root)
        if not partition.folder:
            return
        for info in system.get_file_info(fs.FileSelector(partition.folder, recursive=partition.deep)):
            path = info.path[len(root) :].lstrip("/")
            if info.type == fs.FileType.Directory:
                yield path, "folder", None, None, info.mtime
            elif info.type == fs.FileType.File:
                with system.open_input_stream(info.path) as f:
                    yield path, "file", info.size, f.read(self.head), info.mtime


def file_tree(spark: SparkSession, root: str, head: int = 8, parts: int = 64) -> DataFrame:
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").option("head", head).option("parts", parts).load(root)


def decoded(data: bytes, encodings: tuple[str, ...]) -> tuple[str | None, str | None]:
    """The text and the first encoding in which all bytes are sound; nulls if none is. Unknown encodings are passed over."""
    for encoding in encodings:
        try:
            return data.decode(encoding), encoding
        except (UnicodeDecodeError, LookupError):
            continue
    return None, None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_texts(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """(path, text, encoding, sha256) of whole files: the text in the first encoding that takes all of it; null text if none does."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "text", "encoding", "sha256"), (name, *decoded(data, encodings), hashlib.sha256(data).hexdigest()), strict=True))], pa.schema([(c, pa.string()) for c in ("path", "text", "encoding", "sha256")]))

    return _files(spark, path).mapInArrow(task, "path string, text string, encoding string, sha256 string")


def read_csv_any(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """(path, encoding, line, cells, reason) of the rows of CSV files whose encoding isn't known: cells is a map by column name.

    Each file is tried whole, in one task, since a byte far down may rule an encoding out; so a file must fit in a task's
    memory (Spark reads none above 2 GB this way). ``line`` counts rows from 1. reason: undecodable (one row for the file,
    without cells), ragged (more or fewer cells than columns; missing ones are absent from the map, surplus ones are
    dropped), or empty text. Blank lines are no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, encoding = decoded(data, encodings)
                if text is None:
                    yield _cells([(name, None, None, [], "undecodable")])
                    continue
                rows = (r for r in csv.reader(io.StringIO(text, newline="")) if r)
                names, out = next(rows, []), []
                for i, r in enumerate(rows, 1):
                    out.append((name, encoding, i, list(dict(zip(names, r)).items()), "" if len(r) == len(names) else "ragged"))
                    if len(out) == 1000:
                        yield _cells(out)
                        out = []
                if out:
                    yield _cells(out)

    return _files(spark, path).mapInArrow(task, "path string, encoding string, line long, cells map<string,string>, reason string")


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "encoding", "line", "cells", "reason"])


def content_audit(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """(name, status, size, sha256) of files below a folder against ``expected`` (name, sha256): sound, changed, missing, unexpected, repeated.

    ``name`` is the path from the root. A name that ``expected`` has with several digests is repeated.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.regexp_replace("path", "^[a-z]+:/*", "/")
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    held = files.select(F.substring(at, F.lit(len(base) + 1), F.length(at)).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    asked = expected.groupBy("name").agg(F.first("sha256").alias("_want"), F.count_distinct("sha256").alias("_n"))
    out = held.join(asked, "name", "full_outer")
    status = F.when(F.col("_n") > 1, "repeated").when(F.col("sha256").isNull(), "missing").when(F.col("_n").isNull(), "unexpected").when(F.col("sha256") == F.col("_want"), "sound").otherwise("changed")
    return out.select("name", status.alias("status"), "size", "sha256")
