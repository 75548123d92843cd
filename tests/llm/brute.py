"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    words = space_words(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def contamination(docs, benchmark, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns = {}
    for item, text in benchmark:
        w = word.findall(ascii_lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            patterns.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(p) for p in patterns}
    out = {}
    for doc, text in docs:
        w, hit, items = word.findall(ascii_lower(text)), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                found = patterns.get(tuple(w[i : i + m]))
                if found:
                    hit |= set(range(i, i + m))
                    items |= found
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(items), sha, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def substrings(docs, window=35):
    split = [(d, space_words(t)) for d, t in docs]
    counts = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = {}
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def shingle_set(text, n=5):
    w = space_words(ascii_lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_components(docs):
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, postings = sorted(sets), {}
    for d in ids:
        for s in sets[d]:
            postings.setdefault(s, []).append(d)
    pairs = {(a, b) for found in postings.values() for i, b in enumerate(found) for a in found[:i]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
