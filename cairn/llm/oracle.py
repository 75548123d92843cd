"""SQL of corpus queries, for a second engine over the same tables."""

from __future__ import annotations

#: Words without ASCII white space of every document, in order; a null text has none.
_SPACE_WORDS = r"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MATCH = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP2 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_MATCH}) AS w FROM documents),
  b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS m FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_MATCH}) AS w FROM benchmark) WHERE len(w) > 0),
  p AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
  s AS (SELECT DISTINCT m FROM p),
  g AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN s)),
  o AS (SELECT g.doc_id, g.i, g.m, p.item FROM g JOIN p ON g.m = p.m AND g.g = p.g),
  h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM o) GROUP BY 1),
  t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY 1)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP6 = f"""WITH d AS ({_SPACE_WORDS}),
  g AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
  r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
  x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
  k AS (SELECT v.doc_id, string_agg(v.word, ' ' ORDER BY v.k) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) v LEFT JOIN x ON x.doc_id = v.doc_id AND x.k = v.k WHERE x.k IS NULL GROUP BY 1)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + 4], ' ') || '/' || least(5, len(w))) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n"""

OP11 = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS own, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.e) = len(b.e)),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
  n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS k FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT own AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
  SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS "rank", negative_id, positive_score, negative_score FROM n WHERE k <= 5"""

OP13 = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
  t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
  g AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 30),
  c AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM g WHERE len(g) > 1),
  z AS (SELECT c.lang, c.g, a, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score, k FROM c JOIN g x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN g y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
  m AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
  o AS (SELECT lang, h AS g, max(f) AS longer FROM (SELECT lang, f, unnest(list_transform(flatten(list_transform(range(2, len(g)), lambda q: list_transform(range(1, len(g) - q + 2), lambda i: [i, q]))), lambda u: g[u[1]:u[1] + u[2] - 1])) AS h FROM g WHERE len(g) > 2) GROUP BY ALL),
  e AS (SELECT m.lang, array_to_string(m.g, ' ') AS phrase, a, l, r, score FROM m LEFT JOIN o ON o.lang = m.lang AND o.g = m.g WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
  SELECT e.lang, row_number() OVER (PARTITION BY e.lang ORDER BY score DESC, a DESC, phrase) AS "rank", phrase, a, l, r, n, score FROM e JOIN t ON t.lang = e.lang QUALIFY "rank" <= 2000"""


def _url_graph(rules: list[tuple[str, str, str]], link: str, mass: float, rounds: int) -> str:
    """The rules by their length, then the rounds of trust and distrust one after the other, in whole numbers."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({text(v)}, {text(h)}, {text(p)})" for v, h, p in rules)
    steps = ["r0 AS (SELECT kind, host, seed AS rank FROM s)"]
    for i in range(1, rounds + 1):
        steps.append(f"g{i} AS MATERIALIZED (SELECT e.kind, e.dst AS host, CAST(sum(CAST(floor(rank * share) AS BIGINT)) AS BIGINT) AS got FROM e JOIN r{i - 1} r ON r.kind = e.kind AND r.host = e.src GROUP BY ALL), r{i} AS MATERIALIZED (SELECT kind, host, CAST(floor(coalesce(seed, 0) * (1 - CAST(0.85 AS DOUBLE))) AS BIGINT) + CAST(floor(coalesce(got, 0) * CAST(0.85 AS DOUBLE)) AS BIGINT) AS rank FROM s FULL JOIN g{i} USING (kind, host))")
    return f"""WITH a AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS k FROM pages),
  x AS (SELECT k, v, h || p AS rule FROM a JOIN (VALUES {listed}) AS u(v, h, p) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC, v DESC) = 1),
  p AS (SELECT a.*, rule, v FROM a LEFT JOIN x USING (k)),
  c AS (SELECT host, count(*) AS n_pages, count(*) FILTER (v = 'allow') AS allowed, count(*) FILTER (v = 'block') AS blocked FROM p WHERE host <> '' GROUP BY 1),
  t AS (SELECT greatest(1, sum(allowed + blocked)) AS total FROM c),
  s AS (SELECT kind, host, CAST(floor({mass!r} * (n / CAST(total AS DOUBLE))) AS BIGINT) AS seed FROM (SELECT 'trust' AS kind, host, allowed AS n FROM c UNION ALL SELECT 'distrust', host, blocked FROM c) CROSS JOIN t WHERE n > 0),
  l AS (SELECT host AS src, translate(y, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM (SELECT host, unnest(regexp_extract_all(html, {text(link)}, 1)) AS y FROM p) WHERE host <> ''),
  n AS (SELECT host FROM c UNION SELECT dst FROM l WHERE src <> dst AND dst <> ''),
  d AS (SELECT DISTINCT array_to_string(q[i:], '.') AS lo, array_to_string(q[i + 1:], '.') AS hi FROM (SELECT q, unnest(range(1, len(q) - 1)) AS i FROM (SELECT string_split(host, '.') AS q FROM n))),
  f AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1 AS w FROM l WHERE src <> dst UNION ALL SELECT lo, hi, 1 FROM d UNION ALL SELECT hi, lo, 1 FROM d) GROUP BY 1, 2),
  e AS MATERIALIZED (SELECT kind, src, dst, w / CAST(sum(w) OVER (PARTITION BY kind, src) AS DOUBLE) AS share FROM (SELECT 'trust' AS kind, src, dst, w FROM f UNION ALL SELECT 'distrust', dst, src, w FROM f)),
  {', '.join(steps)},
  j AS (SELECT host, n_pages, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM c LEFT JOIN r{rounds} USING (host) GROUP BY ALL),
  b AS (SELECT host FROM j CROSS JOIN t WHERE distrust > 0 AND 100 * distrust >= 50 * (trust + distrust) AND distrust >= n_pages * (0.01 * {mass!r} / total))
  SELECT page_id, p.host, path, rule, coalesce(v, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM p LEFT JOIN b ON b.host = p.host"""


def url_graph_sql(rules: list[tuple[str, str, str]], link: str) -> str:
    return _url_graph(rules, link, 1e15, 20)


SQL = {"op11_hard_negatives": OP11, "op13_collocations": OP13, "op2_decontamination": OP2, "op6_substring_dedup": OP6, "op7_ngram_jaccard_join": OP7}
