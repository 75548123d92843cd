"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment of shingles verifies.

Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.license_texts import WORDINGS

#: What is looked for. Short notices, and the wordings of public licenses.
TEMPLATES = WORDINGS | {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: str, n: int) -> Column:
    """Hashes of every n consecutive words."""
    head = F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(head, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, n))))


def _bands(shingles: Column, bands: int, rows: int) -> Column:
    """Hash of each band of the MinHash signature of a set of shingles."""
    least = lambda seed: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, seed)))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, *(least(b * rows + r) for r in range(rows))))


def _matches(docs: DataFrame, templates: DataFrame, n: int, percent: int, bands: int, rows: int, text_col: str) -> DataFrame:
    """(key, name, start, share) of the windows that match one of some templates, by shingles of n words."""
    spark = docs.sparkSession
    known = templates.withColumn("shingles", F.array_distinct(_shingles("words", n))).select("name", F.size("words").alias("length"), "shingles").collect()
    every = F.array(*(F.lit(x) for x in sorted({x for r in known for x in r["shingles"]})))
    # The key is numbered beside the shingles: so the filter isn't moved below them, which would split texts anew.
    split = docs.select(_words(F.col(text_col)).alias("words"))
    near = split.select(F.monotonically_increasing_id().alias("key"), _shingles("words", n).alias("shingles")).where(F.arrays_overlap("shingles", every))

    # Windows of one length serve all templates of that length; which of those they hold is for the bands to say.
    own_sizes = {r["length"]: min(len(x["shingles"]) for x in known if x["length"] == r["length"]) for r in known}
    lengths = F.array(*(F.struct(F.lit(x).alias("length"), F.lit(k).alias("least")) for x, k in sorted(own_sizes.items())))
    stride = F.greatest(F.floor(F.col("length") / 4).cast("int"), F.lit(1))
    size = F.ceil(F.col("length") * 100 / percent).cast("int") + stride - 1 - (n - 1)  # shingles in a window
    # Only windows over a place of a known shingle can hold a template: of the places, each names the windows over it.
    # The intersection is bound to a name of the lambda; as a column it would be worked out anew for each shingle.
    within = F.transform(F.array(F.array_intersect("shingles", every)), lambda h: F.array_compact(F.transform("shingles", lambda x, i: F.when(F.array_contains(h, x), i))))
    placed = near.select("key", "shingles", F.get(within, F.lit(0)).alias("places")).withColumn("l", F.explode(lengths)).select("key", "l.*", "shingles", "places").select("key", "length", "least", "shingles", "places", size.alias("size"), stride.alias("stride"))
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - F.col("size") + 1) / F.col("stride"))).cast("int") * F.col("stride")
    starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(first(p), p - p % F.col("stride"), F.col("stride")))))
    enough = 100 * F.size(F.filter("places", lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("size")))) >= percent * F.col("least")
    windows = placed.withColumn("start", F.explode(starts)).where(enough).select("key", "length", "start", F.slice("shingles", F.col("start") + 1, F.col("size")).alias("window"))
    signed = windows.withColumn("bands", _bands(F.col("window"), bands, rows))
    templates_signed = spark.createDataFrame([(r["name"], r["length"], r["shingles"]) for r in known], "name string, length int, own array<long>").withColumn("bands", _bands(F.col("own"), bands, rows))
    # One row for each band; the side of the templates has a few hundred.
    by_band = templates_signed.select("name", "length", "own", F.posexplode("bands").alias("band", "value"))
    exploded = signed.select("key", "length", "start", "window", F.posexplode("bands").alias("band", "value"))
    retrieved = exploded.join(F.broadcast(by_band), ["length", "band", "value"]).select("key", "name", "start", "window", "own").dropDuplicates(["key", "name", "start"])
    share = (100.0 * F.size(F.array_intersect("window", "own")) / F.size("own")).alias("share")
    return retrieved.select("key", "name", "start", share).where(F.col("share") >= percent)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, n: int = 5, percent: int = 80, bands: int = 40, rows: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Templates of which a window of a document contains ``percent`` of 100 of the distinct shingles of ``n`` words.

    Words are runs of letters and digits in lower case. Each template has windows of its own: their stride is a
    quarter of its words, their length 100 / ``percent`` of its words and a stride less one. So a copy into which as
    many words were inserted as ``percent`` admits to be lost lies within one, wherever it begins. Then window and
    template have a Jaccard similarity of about 0.45 even at 80 in 100, and ``bands`` of ``rows`` rows collide with a
    probability above 0.999. Bands alone say which templates a window is compared with; windows with fewer known
    shingles, of whichever templates, than one of that length needs cannot match and have no signature. A template of fewer than ``n`` words is one shingle of all its words.

    Returns a row for each row: the id, n_licenses, licenses (names, sorted, joined by commas; empty for none),
    n_windows (windows that match), best_percent (largest share found, 0 to 100). A null or short text matches
    nothing; a very long one has more windows. A share of just ``percent`` matches, and all templates that match are
    named, equal ones too. Rows must come in the same order when the input is read again. Templates are few and given as an argument; one without a word is refused. Null and repeated
    ids are rows like any other, and other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    named = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "name string, template string")
    words = named.withColumn("words", _words(F.col("template"))).withColumn("size", F.least(F.size("words"), F.lit(n)))
    sizes = sorted({r["size"] for r in words.select("size").collect()})
    if 0 in sizes:
        raise ValueError("templates without a word")
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    matched = None
    for size in sizes:
        found = _matches(docs, words.where(F.col("size") == size), size, percent, bands, rows, text_col)
        matched = found if matched is None else matched.unionByName(found)
    summed = matched.groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("n_windows"), F.max("share").alias("best_percent"))
    out = keyed.select("key", "id").join(summed, "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
        F.coalesce("best_percent", F.lit(0.0)).alias("best_percent"),
    )
