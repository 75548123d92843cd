"""Writers that check what they write."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: How CSV is written and read: quotes are doubled, blanks and line ends within cells stay.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}


def canonical(df: DataFrame) -> DataFrame:
    """Cells as text: twelve decimals, TRUE and FALSE."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.format_string("%.12f", c) if kinds[c] in ("double", "float") else F.upper(F.col(c).cast("string")) if kinds[c] == "boolean" else F.col(c).cast("string")
    return df.select(*(cell(c).alias(c) for c in df.columns))


def defects(df: DataFrame) -> dict[str, int]:
    """Counts of rows, of null or blank cells, of non-finite numbers, and of repeated rows."""
    kinds = dict(df.dtypes)
    blank = sum((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("int") for c in df.columns)
    odd = sum(((F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).cast("int") for c in df.columns if kinds[c] in ("double", "float")), F.lit(0))
    one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(blank), F.lit(0)).alias("blank"), F.coalesce(F.sum(odd), F.lit(0)).alias("non_finite")).first()
    groups = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
    return {"rows": one["rows"], "blank": one["blank"], "non_finite": one["non_finite"], "repeated": groups}


def write_table(df: DataFrame, path: str, form: str = "parquet", strict: bool = False) -> int:
    """Writes to a staging folder, reads the rows back to count them, and only then gives the folder its name.

    An existing path is refused. ``strict`` refuses empty tables, blank cells, non-finite numbers and repeated rows.
    """
    spark: SparkSession = df.sparkSession
    if strict:
        found = defects(df)
        if not found["rows"] or found["blank"] or found["non_finite"] or found["repeated"]:
            raise ValueError(f"refused: {found}")
    jvm = spark.sparkContext._jvm
    target, staging = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.staging")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    options = CSV if form == "csv" else {}
    counted = Observation()  # the rows that the write itself sees, so the plan runs once
    (canonical(df) if form == "csv" else df).observe(counted, F.count("*").alias("rows")).write.mode("overwrite").format(form).options(**options).save(f"{path}.staging")
    again = {"multiLine": True} if form == "csv" else {}
    expected, written = counted.get["rows"], spark.read.format(form).options(**options, **again).load(f"{path}.staging").count()
    if expected != written or not fs.rename(staging, target):
        fs.delete(staging, True)
        raise OSError(f"{path}: {written} rows written, {expected} expected")
    return written


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small document with sorted keys, written beside its place and renamed over it: readers see the old or the new one, never none."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    conf = context._jsc.hadoopConfiguration()
    target, staging = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.staging")
    fs = target.getFileSystem(conf)
    out = fs.create(staging, True)
    try:
        out.write(bytearray((json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()
    over = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(staging), fs.makeQualified(target), over)


def write_set(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> dict[str, int]:
    """Writes several tables so that either all or none stand in ``folder``: they are staged together and renamed at once."""
    spark = next(iter(tables.values())).sparkSession
    jvm = spark.sparkContext._jvm
    target, staging = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(f"{folder}.staging")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(folder)
    fs.delete(staging, True)
    try:
        written = {name: write_table(df, f"{folder}.staging/{name}", form) for name, df in tables.items()}
    except Exception:
        fs.delete(staging, True)
        raise
    if not fs.rename(staging, target):
        raise OSError(folder)
    return written


def wide_predictions(rows: DataFrame, p: str, t: str, classes: int) -> DataFrame:
    """The other columns, then probability_<k>, threshold_<k> and decision_<k> of each class."""
    wide = [F.get(p, k).alias(f"probability_{k}") for k in range(classes)] + [F.get(t, k).alias(f"threshold_{k}") for k in range(classes)]
    decided = [(F.get(p, k) >= F.get(t, k)).cast("int").alias(f"decision_{k}") for k in range(classes)]
    return rows.select(*(c for c in rows.columns if c not in (p, t)), *wide, *decided)


def fingerprint(df: DataFrame) -> str:
    """A hash of the rows that no order changes: sums of two 64-bit hashes, and the count."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(text, F.lit(1)).cast("decimal(38,0)")).alias("b")).first()
    return f"{row['n']}:{row['a']}:{row['b']}"
