"""Hard negatives, verdicts on urls and collocations against plain versions, on small tables with odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import collocations, hard_negatives, url_graph
from cairn.llm.common import lookup
from cairn.llm.registry import URL_RULES

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, row long, cells string"


def plain_negatives(rows, is_anchor, positives=5, negatives=5):
    use = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, c) in enumerate(use):
        if is_anchor(i):
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j, d) for b, (j, w, d) in enumerate(use) if b != a and len(w) == len(v))
            for s, j, _ in [x for x in scored if x[2] == c][:positives]:
                near = [x for x in scored if x[2] != c and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
                out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.integer_vectors(df, "vec_id"), F.col("id") % 5 == 0, **how).collect())


@pytest.mark.parametrize("how", [{}, {"bits": 1, "anchors_per_block": 7, "rows_per_block": 30}, {"bits": 8, "positives": 2, "negatives": 3}])
def test_hard_negatives(spark, how):
    r = random.Random(11)
    centre = [[r.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = [(i, [x + r.gauss(0, 0.4) for x in centre[i % 3]], r.randrange(3)) for i in range(150)]
    rows = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows]
    rows += [(150 + i, rows[10 * i][1], r.randrange(3)) for i in range(8)] + [rows[0], rows[0], rows[5]]  # ties and repeated rows
    rows += [(200, None, 1), (205, [1.0] * 6, None), (None, [1.0] * 6, 1), (210, [math.nan] + [1.0] * 5, 1), (215, [math.inf] + [1.0] * 5, 1), (220, [None] + [1.0] * 5, 1), (225, [1.0, 2.0], 1), (226, [1.0, 2.0], 1), (227, [1.0, 1.9], 0), (230, [], 1), (231, [], 1), (232, [], 2), (235, [-0.5] * 6, 9)]
    df = spark.createDataFrame([(i, v, c, "x", "x", 0, "x") for i, v, c in rows], VECTORS)
    assert mined(df, **how) == plain_negatives(rows, lambda i: i % 5 == 0, how.get("positives", 5), how.get("negatives", 5))


def test_hard_negatives_of_wide_numbers_and_of_nothing(spark):
    rows = [(i, [float(np.float32(1e6 * (i % 7))), 3.0 + i], i % 2) for i in range(30)]
    df = spark.createDataFrame([(i, v, c, "x", "x", 0, "x") for i, v, c in rows], VECTORS)
    assert mined(df) == plain_negatives(rows, lambda i: i % 5 == 0)
    assert mined(df.where("vec_id < 0")) == [] and mined(df.where("label = 0")) == []


def test_bounds_hold(spark):
    r = np.random.default_rng(2)
    v = r.integers(-90, 90, (300, 5))
    for bits in (1, 3, 8):
        cells = hard_negatives.Cells({d: (int(c.min()), int(c.max()), float(c.mean()), float(c.std())) for d, c in enumerate(v.T)}, bits)
        low, high = cells.bounds(v[:20].astype(float), cells.of(v))
        assert (low <= v @ v[:20].T).all() and (high >= v @ v[:20].T).all()


URLS = ["http://a.example.com/en/x", "HTTPS://WWW.Example.COM/en/?q=1", "https://sub.www.example.com/en/", "http://x.net/es/1#y", "http://net/fr/", "x://y.net/de/://z", "no scheme", "", None, "http://host", "http://user@h.net:80/es/1", "http://Ünï.net/fr/é?x", "a://\nb.net/es/\nx", "://q.net/es/"]


def plain_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[:0:-1] if fits else (None, None))


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, None, "x", "x") for i, u in enumerate(URLS)] + [(None, URLS[0], None, "x", "x"), (0, URLS[0], None, "x", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")
    for parts in (1_000_000, 3):
        got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_graph.judge(df, URL_RULES, rows_per_part=parts).collect()]
        assert len(got) == len(rows)
        for i, host, path, rule, verdict in got:
            want = plain_url(URLS[i or 0])
            assert (host, path, rule) == want[:3] and (want[3] is None or verdict == want[3])
            assert host or verdict == "allow"
    assert url_graph.judge(df.limit(0), URL_RULES).count() == 0


def plain_verdicts(pages, damping=0.85, rounds=20, mass=10**15):
    """Both ranks by the plain rule, over dictionaries."""
    links = Counter()
    for host, _, html in pages:
        for to in re.findall(r"(?i)\s(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)", html or ""):
            if host and to.lower() != host:
                links[host, to.lower()] += 1
    ties = set()
    for name in {h for h, _, _ in pages if h} | {b for _, b in links}:
        while "." in name and "." in name.split(".", 1)[1]:
            ties.add((name, name := name.split(".", 1)[1]))
    for a, b in ties:
        links[a, b] += 1
        links[b, a] += 1
    n, seeds = Counter(h for h, _, _ in pages if h), {k: Counter(h for h, v, _ in pages if v == k and h) for k in ("allow", "block")}
    total, ranks = sum(sum(s.values()) for s in seeds.values()) or 1, {}
    for kind, own in seeds.items():
        edges = links if kind == "allow" else {(b, a): w for (a, b), w in links.items()}
        out = Counter()
        for (a, _), w in edges.items():
            out[a] += w
        seed = {h: math.floor(mass * (c / total)) for h, c in own.items()}
        rank = dict(seed)
        for _ in range(rounds):
            got = Counter()
            for (a, b), w in edges.items():
                got[b] += math.floor(rank.get(a, 0) * (w / out[a]))
            rank = {h: math.floor(seed.get(h, 0) * (1 - damping)) + math.floor(got[h] * damping) for h in seed.keys() | got.keys()}
        ranks[kind] = rank
    d, t = (lambda h: ranks["block"].get(h, 0)), (lambda h: ranks["allow"].get(h, 0))
    return {h: (n[h], t(h), d(h), "block" if d(h) > 0 and 100 * d(h) >= 50 * (t(h) + d(h)) and d(h) >= n[h] * (0.01 * mass / total) else "allow") for h in n}


def test_trust_spreads(spark):
    r = random.Random(6)
    names = [f"{a}{i}.{b}" for i in range(6) for a in ("s", "t") for b in ("one.org", "two.org", "three.org")] + ["hub.org", ""]
    pages = []
    for i in range(200):
        to = [f'<a class="x" HREF = "{r.choice(("http:", "https:", ""))}//{r.choice(names[:-1]).upper() if i % 9 == 0 else r.choice(names[:-1])}/p">' for _ in range(r.randrange(4))]
        pages.append((r.choice(names) if i % 3 else "hub.org", r.choice(("allow", "block", None, None)), None if i % 17 == 0 else "<p>" + " ".join(to) + '<a href="/local"> <img src=\'//cdn.example.net/x\'>'))
    df = spark.createDataFrame(pages, "host string, verdict string, html string")
    got = {x["host"]: tuple(x)[1:] for x in url_graph.host_verdicts(df).collect()}
    want = plain_verdicts(pages)
    assert got == want and {v for *_, v in want.values()} == {"allow", "block"}


def test_a_page_that_links_to_blocked_hosts_is_distrusted(spark):
    bad = '<a href="http://bad.org/">'
    pages = [("bad.org", "block", None)] * 5 + [("good.org", "allow", '<a href="http://friend.org">')] * 5 + [("friend.org", None, None), ("farm.org", None, bad), ("far.org", None, None)]
    got = {x["host"]: x["verdict"] for x in url_graph.host_verdicts(spark.createDataFrame(pages, "host string, verdict string, html string")).collect()}
    assert got == {"bad.org": "block", "good.org": "allow", "friend.org": "allow", "farm.org": "block", "far.org": "allow"}


def test_lookup_of_frequent_keys(spark):
    rows = spark.createDataFrame([(7 if i % 3 else i % 5, i) for i in range(300)] + [(None, 1)], "k long, i long")
    table = spark.createDataFrame([(k, k * 2) for k in range(4)] + [(7, 14)], "k long, v long")
    for parts in (1, 8):
        assert lookup(rows, table, ["k"], ["i"], parts).count() == rows.where("k IN (0, 1, 2, 3, 7)").count()
        left = lookup(rows, table, ["k"], ["i"], parts, "left")
        assert left.count() == 301 and left.where("v IS NULL").count() == rows.where("k IS NULL OR k = 4").count()


def plain_collocations(docs, least, most, share=80):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        found, longer = [], defaultdict(int)
        for g, a in own.items():
            if a >= least:
                for k in range(2, len(g)):
                    for i in range(len(g) - k + 1):
                        longer[g[i : i + k]] = max(longer[g[i : i + k]], a)
        for g, a in own.items():
            if len(g) > 1 and a >= least and not 100 * longer[g] >= share * a:
                s, k = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k) for k in range(1, len(g)))
                found.append((-s, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_words, part_bytes, rows_per_part, buckets", [(4_000_000, 4_000_000, 1_000_000, 2_000_000), (60, 200, 7, 300)])
def test_collocations(spark, shard_words, part_bytes, rows_per_part, buckets, monkeypatch):
    r = random.Random(4)
    words = ["a", "B", "c", "the", "New", "York", "é", "中", "ab\x00c", "x\x1fy", "\u00a0"]
    phrases = ["New York City", "the a the a", "c c c c c", "é 中", "in spite of that", "a \x00. b"]
    docs = []
    for i in range(120):
        text = "".join(r.choice((r.choice(phrases), r.choice(words), r.choice(words))) + r.choice((" ", "  ", "\t", " ", ". ", ",", "\n", "!?", "\x0b", "\r\n")) for _ in range(r.randrange(40)))
        docs.append((r.choice(("en", "en", "en", "de", None, "und")), text))
    docs += [("en", None), ("en", ""), ("fr", " \n . "), ("en", "New York City " * 3000), ("de", "one" * 5000)] + [docs[0]] * 5
    df = spark.createDataFrame([(i, t, c, "x", "x", 1) for i, (c, t) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, word string, n long").repartition(3)
    monkeypatch.setattr(collocations.shards, "__defaults__", ("text", "lang", shard_words, part_bytes))
    monkeypatch.setattr(collocations.frequent_phrases, "__defaults__", (30, buckets))
    got = sorted(tuple(x) for x in collocations.top_collocations(df, least=4, most=40, shard_words=shard_words, rows_per_part=rows_per_part).collect())
    assert got == plain_collocations(docs, 4, 40)
    assert collocations.top_collocations(df.limit(0)).count() == 0 and collocations.top_collocations(df.where("lang = 'fr'")).count() == 0


def test_suffix_arrays():
    r = np.random.default_rng(3)
    for depth in (2, 4):
        words = r.integers(0, 4, 300)
        linked = np.append((words[:-1] > 0) & (words[1:] > 0) & (r.random(299) < 0.9), False)
        at, shared, room = collocations.suffix_array(words, linked, depth)
        for n in range(2, depth + 1):
            want = Counter(tuple(words[i : i + n]) for i in range(300 - n + 1) if linked[i : i + n - 1].all())
            begin, counts = collocations.intervals(at, shared, room, n)
            assert {tuple(words[b : b + n]): c for b, c in zip(begin, counts)} == want


def test_packed_numbers():
    a = np.array([0, 5, -1, 2**62], np.int64)
    assert (collocations._unpack(collocations._pack(a, a + 1 - 1, a), 3) == a).all()
    assert (collocations._unpack(collocations._pack(a[:2]), 1)[0] == a[:2]).all()
    assert collocations._unpack(collocations._pack(a[:0]), 1).shape == (1, 0)
