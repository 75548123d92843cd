"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names, against plain versions."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import common, decontaminate, divergence, lang_id, license_scan, line_dedup, ngram_join, packing, rule_ensemble, substring, token_counts
from cairn.llm.bpe_transducer import Tokenizer
from cairn.llm.registry import vocabulary_path
from tests.llm import brute

R = random.Random(5)
VOCAB = ["".join(R.choice("etaoinshr") for _ in range(R.randint(2, 8))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, changes, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = "zq" + r.choice(VOCAB)
    return " ".join(words)


BASE, PASSAGE = prose(160, 1), prose(60, 2)
TEXTS = [BASE, BASE, edited(BASE, 1, 3), edited(BASE, 2, 4), edited(BASE, 5, 5), None, "", "  \n\t ", "one", "the the the the", f"{prose(40, 6)} {PASSAGE} {prose(30, 7)}", f"{PASSAGE} {prose(90, 8)}", f"{prose(10, 9)}\n{PASSAGE}\n\n{PASSAGE}", "a b c d", "A B C D", "été 中文 <|endoftext|> don't 's  \n x", prose(30_000, 10)]
ROWS = list(enumerate(TEXTS)) + [(None, "a row without an id that is long enough to be a line")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n string, key string, root string, line string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("docs"))
    rows = [(i, t, "en" if t and k % 3 else None, "s", len(t or ""), "x", "x", "x", "x", "x") for k, (i, t) in enumerate(ROWS)]
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, "one"), (3, None), (None, prose(20, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_divergence(docs):
    got = by_id(divergence.judge(docs, divergence.fit_references(docs)))
    for i, t in ROWS:
        assert tuple(got[i][1:7]) == brute.base_counts(t)
    assert not got[5]["kept"] and len(got) == len(ROWS)


@pytest.mark.parametrize("block", [16_000_000, 100])
def test_decontamination(spark, docs, block):
    items = [(1, PASSAGE), (2, "one"), (3, None), (4, "a b"), (5, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.find_contamination(docs, bench, block_chars=block))
    assert {i: tuple(r[1:6]) for i, r in got.items()} == brute.contamination(ROWS, items)


def test_edit_distance_and_segments():
    r = random.Random(3)
    for _ in range(3000):
        tau, letters = r.choice([1, 2, 3]), r.choice(["ab", "abcdefgh"])
        a = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            i = r.randint(0, len(b))
            b[i : i + r.randint(0, 1)] = r.choice(["", r.choice(letters)])
        b = "".join(b)
        near = brute.edit_distance(a, b) <= tau
        assert line_dedup.within(a, b, tau) == near
        x, y = sorted((a, b), key=len)
        if near and len(x) > tau:
            assert set(line_dedup.index_keys(x, tau)) & set(line_dedup.probe_keys(y, tau))


def test_line_dedup(spark):
    line, other = prose(8, 40), prose(9, 41)
    texts = [f"{line}\n{other}", f"{line}x\nshort", line[1:] + "yy", f"  {line} \n{other[:-3]}###", None, "", f"{other}\n{other}"]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(6, texts[6], "k")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, number string").coalesce(1), with_text=True)
    seen, want = [], []
    for _, t, _ in rows:
        kept = []
        for x in (t or "").split("\n"):
            k = x.strip()
            if len(k) < 24 or not any(brute.edit_distance(k, y) <= 2 for y in seen):
                kept.append(x)
            if len(k) >= 24:
                seen.append(k)
        want.append("\n".join(kept))
    assert sorted(r["kept_text"] for r in got.collect()) == sorted(want)


def test_line_dedup_of_short_lines(spark):
    texts = ["All rights reserved.\nok\n\nabcdef", "all rights reserved.\nok\n \nabcdeg", " ok\nfour\nAll rights reserve", "All right reserved.\nfour", "abcdefghijklmnopqrstuvw\nxy", "abcdefghijklmnopqrstuvwx\nxy\nabcdefghijklmnopqrstuVWx"]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_text=True)
    seen, want = [], {}
    for i, t in enumerate(texts):
        kept = []
        for x in t.split("\n"):
            k = x.strip()
            if not any(brute.edit_distance(k, y) <= min(2, min(len(k), len(y)) // 12) for y in seen):
                kept.append(x)
            if k:
                seen.append(k)
        want[i] = "\n".join(kept)
    assert {r["doc_id"]: r["kept_text"] for r in got.collect()} == want
    assert want[1] == " \nabcdeg" and want[3] == ""


def test_rule_ensemble(spark):
    good = [(i, prose(80, i), 1) for i in range(60)]
    bad = [(100 + i, " ".join(w + "$$$" for w in prose(80, i).split()), 0) for i in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad], "doc_id long, quality int")
    model = rule_ensemble.fit(rows, labels, trees=5)
    got = by_id(rule_ensemble.predict(rows, model))
    assert all(got[i]["predicted"] == y for i, _, y in good + bad)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 102
    assert rule_ensemble.fit(rows, labels.limit(0)).rules == ()


def test_language(spark):
    words = {"aa": "lorem ipsum dolor amet".split(), "bb": "grün über straße wörter".split()}
    rows = [(i, " ".join(random.Random(i).choices(words[k], k=20)), k) for i, k in enumerate(["aa", "bb"] * 20)]
    rows += [(100, None, "aa"), (101, "12 ² 34 !", None), (102, "doloris", None), (103, "überwörter", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(lang_id.predict(docs, lang_id.fit(docs)))
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:40])
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "aa", "bb"]
    assert lang_id.fit(docs.limit(0)).predict("word") == ("und", 0.0)


def test_language_scores_by_the_plain_rule(spark):
    """Word by word, over known, unseen and foreign words; a table that holds five words gives the same."""
    turned = [w[::-1] + "ß" for w in VOCAB]
    rows = [(i, " ".join(random.Random(i).choices((VOCAB, turned)[i % 2], k=30)), ("aa", "bb")[i % 2]) for i in range(60)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def plain(text):
        total = [0.0, 0.0]
        for w in lang_id.letter_words(text):
            for n in (0, 5, 4, 3, 2, 1):
                known, matrix = model.tables[n]
                hits = [matrix[known[g]].tolist() for g in (lang_id.grams(w, n) if n else [w]) if g in known]
                if hits:
                    total = [x + sum(h[k] for h in hits) / len(hits) for k, x in enumerate(total)]
                    break
        best = total.index(max(total))
        return model.langs[best], 1 / sum(math.exp(x - total[best]) for x in total)

    r = random.Random(13)
    unseen = ["".join(r.choice("etaoinshrqxß中") for _ in range(r.randint(1, 9))) for _ in range(200)]
    for text in [" ".join(r.choices(VOCAB + turned + unseen, k=r.randint(1, 40))) for _ in range(150)] + ["中", "qx qx"]:
        for own in (model, lang_id.WordBackoff(model.langs, model.tables, most_words=5)):
            lang, score = own.predict(text)
            want, share = plain(text)
            assert score == pytest.approx(share, rel=1e-4) and (lang == want or abs(share - 0.5) < 1e-4)


def test_substrings(docs):
    got = by_id(substring.dedup_substrings(docs))
    assert {i: tuple(r[1:]) for i, r in got.items()} == brute.substrings(ROWS)


def test_substrings_of_a_passage_that_most_texts_share(spark):
    r = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(12)) + f" {passage} " + ("same end " * 3 if i % 3 else f"e{i} " * 9)) for i in range(120)]
    rows += [(i, "again " * r.choice((34, 35, 36, 80))) for i in range(120, 150)]
    got = by_id(substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: tuple(x[1:]) for i, x in got.items()} == brute.substrings(rows)


def test_ngram_join(docs):
    got = by_id(ngram_join.jaccard_components(docs))
    named = [(i, t) for i, t in ROWS if i is not None]
    want = brute.jaccard_components(named)
    assert {i: tuple(got[i][1:]) for i, _ in named} == want
    assert got[None]["component_id"] is None


def test_licenses(spark):
    texts = ["Foo bar. Released under the MIT License. " + prose(50, 1), prose(50, 2) + " Licensed under the Apache License, Version 2.0", "licensed", None, "", "Released under no License", prose(20_000, 3) + " Licensed under CC BY-NC 4.0. " + prose(90, 4)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").coalesce(1)
    got = license_scan.scan_licenses(rows).collect()
    assert sorted((r["doc_id"], r["licenses"]) for r in got) == [(0, "MIT"), (0, "MIT"), (1, "Apache-2.0"), (2, ""), (3, ""), (4, ""), (5, ""), (6, "CC-BY-NC-4.0")]


def test_licenses_with_inserted_words_and_short_templates(spark):
    copy = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
    rows = [(i, f"{prose(i, i)} {copy} {prose(40, i + 100)}") for i in range(24)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 24 and all("MIT-text" in r["licenses"].split(",") for r in got)
    rows = [(i, f"{prose(i, i)} {license_scan.TEMPLATES['MIT-license']} {prose(40, i)}") for i in range(3)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("MIT-license" in r["licenses"].split(",") and r["best_percent"] == 100 for r in got)
    texts = [(0, "Under the MIT-License."), (1, "under the license"), (2, None), (3, "mit license"), (4, "a b c d e f")]
    got = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), {"short": "MIT License", "long": "a b c d e"}).collect()
    assert sorted((r["doc_id"], r["licenses"]) for r in got) == [(0, "short"), (1, ""), (2, ""), (3, "short"), (4, "long")]


def test_licenses_recall_against_containment(spark):
    r, texts = random.Random(9), []
    for i in range(90):
        words = license_scan.TEMPLATES[r.choice(["MIT-text", "BSD-text", "CC-BY-4.0", "MPL-2.0-notice"])].split()
        for _ in range(r.randint(0, 3)):
            words.insert(r.randrange(len(words)), r.choice(VOCAB))
        texts.append(f"{prose(r.randint(0, 90), i)} {' '.join(words)} {prose(30, i + 500)}")
    split = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    grams = lambda w, n: [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
    want = set()
    for i, t in enumerate(texts):
        own = split(t)
        for name, template in license_scan.TEMPLATES.items():
            words = split(template)
            n = min(5, len(words))
            asked, found = set(grams(words, n)), grams(own, n)
            size = -(-len(words) * 100 // 80) - n + 1
            if any(100 * len(asked & set(found[k : k + size])) >= 80 * len(asked) for k in range(max(1, len(found)))):
                want.add((i, name))
    got = {(x["doc_id"], n) for x in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() for n in x["licenses"].split(",") if n}
    assert len(want & got) >= 0.99 * len(want) and len(want) > 40


def test_one_long_word_takes_little_time():
    import time

    from tokenizers import Tokenizer as Library

    word = "".join(random.Random(4).choice("abcdefgh") for _ in range(60_000))
    own = Tokenizer(token_counts.read_vocabulary(vocabulary_path()))
    began = time.perf_counter()
    assert own.count_texts([word]).tolist() == [len(Library.from_file(vocabulary_path()).encode(word, add_special_tokens=False).ids)]
    assert time.perf_counter() - began < 10


def test_packed_ids_and_placement(docs):
    import zlib

    from tokenizers import Tokenizer as Library

    library = Library.from_file(vocabulary_path())
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in ROWS}
    for r in packing.pack(docs, vocabulary_path()).collect():
        part = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"]
    lengths, capacity = np.random.default_rng(2).integers(1, 30, 300), 30
    gaps, counts = [], {}
    bins, _ = packing.sum_of_squares(lengths, capacity)
    for n, to in zip(lengths.tolist(), bins.tolist()):
        total = lambda c: sum(v * v for g, v in c.items() if 0 < g < capacity)

        def after(gap):
            c = dict(counts)
            if gap < capacity:
                c[gap] -= 1
            c[gap - n] = c.get(gap - n, 0) + 1
            return total(c)

        open_gaps = {g for g in gaps if g >= n} | {capacity}
        least = min(map(after, open_gaps))
        gap = gaps[to] if to < len(gaps) else capacity
        assert after(gap) == least
        if gap == capacity:
            gaps.append(capacity)
        else:
            counts[gap] -= 1
        gaps[to] = gap - n
        counts[gap - n] = counts.get(gap - n, 0) + 1


def test_line_dedup_of_many_lines_of_one_pattern(spark):
    """Near, far and equal lines made from one long line, some without an id, against the plain rule."""
    r, base, rows = random.Random(8), prose(30, 90), []
    for i in range(70):
        words = base.split()
        if i % 3:
            for _ in range(i % 4):
                words[r.randrange(len(words))] = r.choice(VOCAB)
        line = list(" ".join(words))
        if i % 2:
            line[r.randrange(len(line))] = "#"
        rows.append((None if i % 10 == 9 else i, "".join(line), "k"))
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, line string").coalesce(1), with_text=True)
    seen, want = [], []
    for _, t, _ in rows:
        want.append("" if any(brute.edit_distance(t, y) <= 2 for y in seen) else t)
        seen.append(t)
    assert sorted(x["kept_text"] for x in got.collect()) == sorted(want)
    assert 10 < want.count("") < 60


def test_tokens_match_the_library(docs):
    from tokenizers import Tokenizer as Library

    library = Library.from_file(vocabulary_path())
    r = random.Random(2)
    letters = "aesrtlvd' \n\t.!1é中　ABC"
    texts = [t or "" for _, t in ROWS] + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["a" * 3000, "<|endoftext|><|endoftext|>"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    own = Tokenizer(token_counts.read_vocabulary(vocabulary_path()), most_pieces=500)
    assert own.count_texts(texts).tolist() == list(map(len, want))
    assert own.id_texts(texts) == [np.array(x, "<u4").tobytes() for x in want]
    got = by_id(token_counts.count_tokens(docs, vocabulary_path()))
    assert {i: (r["n_tokens"], r["n_bytes"], r["over_limit"]) for i, r in got.items()} == {i: (len(w), len((t or "").encode()), len(w) > 1024) for (i, t), w in zip(ROWS, want)}


def test_packing(docs):
    rows = packing.pack(docs, vocabulary_path(), shard_items=5).collect()
    tokens = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, vocabulary_path()).collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, n in tokens.items():
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["start"] for p in parts] == list(np.cumsum([0] + [p["length"] for p in parts])[:-1])
        assert sum(p["length"] for p in parts) == n + 1 and all(p["length"] == 1024 for p in parts[1:])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024


def test_sum_of_squares_fills_bins():
    lengths = np.random.default_rng(1).integers(1, 100, 2000)
    bins, _ = packing.best_of_orders(lengths, 100)
    assert bins.max() + 1 <= -(-lengths.sum() // 100) * 1.02 + 3


def test_empty_tables(docs):
    empty = docs.where("doc_id < -1")
    assert divergence.judge(empty, divergence.fit_references(empty)).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert substring.dedup_substrings(empty).count() == 0
    assert ngram_join.jaccard_components(empty).count() == 0
    assert packing.pack(empty, vocabulary_path()).count() == 0
    assert license_scan.scan_licenses(empty).count() == 0
    assert lang_id.predict(empty, lang_id.fit(empty)).count() == 0
    assert token_counts.count_tokens(empty, vocabulary_path()).count() == 0
    bench = empty.select("doc_id", "text").withColumnRenamed("doc_id", "item_id")
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench).where("n_hit > 0").count() == 0


def test_pipeline(spark, docs):
    folder = docs.inputFiles()[0].rsplit("/", 2)[0]
    cur, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        cur = stage(spark, cur, folder)
        assert cur.columns == names
        cur.write.mode("overwrite").parquet(f"{folder}/{name}")
        cur = spark.read.parquet(f"{folder}/{name}")
    left = {r["doc_id"] for r in cur.collect()}
    assert 0 in left and 1 not in left and 2 not in left and 16 in left
    assert {5, 6, 7, 11, 12}.isdisjoint(left)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == left


def test_pipeline_decides_by_row(spark, docs, tmp_path):
    folder = docs.inputFiles()[0].rsplit("/", 2)[0]
    near = edited(BASE, 1, 50)
    leak = f"{PASSAGE} {prose(20, 51)}"

    def kept(stage, rows):
        at = f"{tmp_path}/{stage.__name__}"
        spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2).write.parquet(at)
        out = stage(spark, spark.read.parquet(at), folder)
        assert out.columns == ["doc_id", "text", "lang"]
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)

    other = prose(80, 52)
    rows = [(1, BASE, "en"), (1, BASE, "en"), (None, near, "en"), (1, other, "en"), (None, prose(70, 53), "en"), (None, None, "en"), (None, None, "en")]
    want = [(1, BASE), (1, other), (None, prose(70, 53)), (None, None), (None, None)]
    assert kept(corpus_pipeline.dedup_near_copies, rows) == sorted(want, key=repr)
    rows = [(1, leak, "en"), (1, other, "en"), (None, leak, "en"), (None, BASE, "en")]
    assert kept(corpus_pipeline.drop_contaminated, rows) == sorted([(1, other), (None, BASE)], key=repr)
    rows = [(i, prose(30, 60 + i), "en") for i in range(8)] + [(1, "12 !", "en"), (None, "34", "en")]
    assert kept(corpus_pipeline.identify_language, rows) == sorted([(i, t) for i, t, _ in rows[:8]], key=repr)


def test_ngram_join_of_rows_without_ids(spark):
    words = prose(104, 70).split()
    chain = [" ".join(words[k : k + 90]) for k in (0, 7, 14)]
    rows = spark.createDataFrame([(4, chain[0]), (None, chain[1]), (9, chain[2])], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.jaccard_components(rows).collect()) == [(0, 4), (4, 4), (9, 4)]


def test_near_sets_leave_few_candidate_rows(spark, monkeypatch):
    """Sets just below the similarity share hundreds of n-grams of their prefixes; a pair of them is no row for each."""
    words = [f"w{i}" for i in range(3_000)]
    cut = lambda d, step: [f"x{d}_{i}" if i % step == step // 2 + d else w for i, w in enumerate(words)]
    texts = [" ".join(cut(d, 46)) for d in range(8)] + [" ".join(cut(40, 200)), " ".join(cut(60, 200))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows, ordered = [], ngram_join._Join.ordered

    def counted(self, pairs):
        rows.append((pairs.count(), pairs.distinct().count()))
        return ordered(self, pairs)

    keyed = docs.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("id"), "text")
    common.ensure_checkpoint_dir(spark)
    join = ngram_join._Join(keyed, "bigint", 5, 80, 1000, 1000)
    monkeypatch.setattr(ngram_join._Join, "ordered", counted)
    found = join.linked(join.across(spark.createDataFrame([], "node long, root long")))
    assert found.count() == 1  # the last two; no other pair reaches the similarity
    assert 1 <= rows[0][1] <= 45 and rows[0][0] <= 60 * rows[0][1], rows
    groups = by_id(ngram_join.jaccard_components(docs))
    assert {i: tuple(x[1:]) for i, x in groups.items()} == brute.jaccard_components(list(enumerate(texts)))


def test_ngrams_of_prefixes_meet_in_packs():
    """Packs give back all n-grams that several prefixes hold, and those only, however the prefixes are dealt."""
    r = np.random.default_rng(3)
    for values in ([], [0], [255, 256], [2**64 - 1, 0, 2**40], r.integers(0, 70_000, 300)):
        values = np.array(values, np.uint64)
        assert ngram_join.widen(ngram_join.narrow(values)).tolist() == values.tolist()
    pool = r.integers(0, 2**64, 3_000, np.uint64)
    pool[:2] = 0, 2**64 - 1
    prefixes = [r.choice(pool, k, replace=False) for k in r.integers(0, 300, 40)]
    keys = 2**33 * 5 + np.arange(40)
    want = {(k, i, g) for k, p in zip(keys.tolist(), prefixes) for i, g in enumerate(p.tolist()) if sum(g in q for q in prefixes) > 1}
    for step in (1, 7, 40):
        got, buckets = [], {}
        for a in range(0, 40, step):
            sure, packed = ngram_join.packs(keys[a : a + step], prefixes[a : a + step], 6)
            got += list(zip(keys[a : a + step][sure[0]].tolist(), sure[1].tolist(), sure[2].tolist()))
            for x in packed:
                buckets.setdefault(x[0], []).append(x)
        for x in buckets.values():
            found = ngram_join.meet(pa.table(dict(zip(("bucket", "least", "base", "grams", "rows", "places"), map(list, zip(*x))))))
            got += list(zip(*(found.column(c).to_pylist() for c in ("key", "pos", "gram"))))
        assert len(buckets) == 6 and len(got) == len(want)
        assert {(k, i, g % 2**64) for k, i, g in got} == want


def test_ngrams_that_one_set_holds_are_shuffled_once(spark):
    """An n-gram of a prefix takes about the bytes of its hash in shuffles, not rows of several."""
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(404))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert ngram_join.jaccard_components(docs).where("component_id = doc_id AND n_shingles = 400").count() == 500
    assert written() - before < 20 * 500 * 81


def test_ngram_join_with_dealt_and_packed_parts(spark, monkeypatch):
    """Results are the same where packs are small, n-grams are frequent and their sets are dealt."""
    r = random.Random(8)
    bases = [prose(90, 300 + i) for i in range(6)]
    rows = [(i, edited(bases[i % 6], r.choice((0, 1, 2, 3, 4)), i)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).checkpoint()
    want = brute.jaccard_components(rows)
    assert 6 < len({x[1] for x in want.values()}) < 80
    for packed, few, share in ((500_000, 100, 1_000), (1, 2, 3)):
        for name, value in (("PACKED", packed), ("FEW", few), ("SHARE", share)):
            monkeypatch.setattr(ngram_join, name, value)
        for broadcast_rows in (0, 1_000):
            assert {i: tuple(x[1:]) for i, x in by_id(ngram_join.jaccard_components(docs, broadcast_rows=broadcast_rows)).items()} == want


def test_hot_segments_are_dealt_in_tasks_and_nothing_is_sorted_for_them(spark, monkeypatch):
    """Each index row of a hot key meets each of its probes once, and results are those without dealing."""
    part, lines = np.array([5, 7, 5, 5, 9], np.uint64), np.arange(5, dtype=np.int64) * 77 - 100
    hot, salts, of = np.array([5, 9], np.int64), np.array([3, 2], np.int64), np.arange(5)
    at, key = line_dedup.dealt(of, part, lines, hot, salts, False)
    to, probe = line_dedup.dealt(of, part, lines, hot, salts, True)
    assert len(key) == 5 and len(probe) == 3 * 3 + 1 + 2
    assert sorted((int(a), int(b)) for a, x in zip(at, key) for b, y in zip(to, probe) if x == y) == [(a, b) for a in range(5) for b in range(5) if part[a] == part[b]]
    base = prose(12, 7)
    rows = spark.createDataFrame([(i, f"{base} {c}{'x' * (i % 4)}\nown {prose(9, i)}") for i, c in enumerate("abcdefghijklmnop")], "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.dedup_lines(rows).collect()))
    assert sum(r[4] for r in want) > 5
    monkeypatch.setattr(line_dedup, "HOT", 3)
    assert sorted(map(tuple, line_dedup.dedup_lines(rows).collect())) == want
