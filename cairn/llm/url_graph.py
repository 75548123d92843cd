"""Verdicts on urls: rules where one fits, and trust and distrust that spread over links between hosts elsewhere.

Trust is a personalised PageRank whose jumps lead to hosts with allowed pages; distrust is one over the reversed edges
whose jumps lead to hosts with blocked pages, so it reaches those who link to them. All in DataFrame functions.

Ranks are whole numbers, so sums don't depend on the order in which tasks finish, and a lost executor changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import lookup, stored

#: A link to another host in a page: the host of an absolute or scheme-relative address in an attribute, in Java's and DuckDB's syntax.
LINK = r"(?i)\s(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"
Rule = tuple[str, str, str]


def lower(x: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Empty for null or no ``://``."""
    return F.coalesce(lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end. Empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest of ``rules`` (verdict, host, path) that fits; nulls where none does.

    A rule fits its host and all subdomains, where the path starts with the rule's. Of equally long ones that with the
    longer host wins, then block. The rules are a policy that people write (at most a few hundred); they become one
    expression.
    """
    text = verdict = F.lit(None).cast("string")
    for given, on, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == on) | F.endswith(host, F.lit("." + on))) & F.startswith(path, F.lit(start))
        text, verdict = F.when(fits, F.lit(on + start)).otherwise(text), F.when(fits, F.lit(given)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, w): links between different hosts, and each host's tie with the domain above it, once each way.

    ``pages`` has ``host``. Relative links stay on their host and say nothing. Domains without a dot tie nothing, since
    hosts of one top-level domain have nothing else in common. Pages of a host are summed before they are shuffled, so a
    host with a third of the pages is no large group.
    """
    to = F.explode(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)), lower)).alias("dst")
    links = pages.select(F.col("host").alias("src"), to).where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    names = pages.select("host").unionByName(links.select(F.col("dst").alias("host"))).where("host <> ''").distinct()
    above = F.expr("filter(transform(sequence(size(split(host, '[.]')), 1, -1), k -> substring_index(host, '.', -k)), d -> contains(d, '.'))")
    ties = names.select(above.alias("d")).where("size(d) > 1").select(F.explode(F.expr("transform(sequence(1, size(d) - 1), k -> named_struct('a', element_at(d, k), 'b', element_at(d, k + 1)))")).alias("tie")).select("tie.*").distinct()
    ties = ties.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(ties.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return links.unionByName(ties.withColumn("w", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, mass: int = 10**15, damping: float = 0.85, rounds: int = 20, rounds_at_once: int = 5, rows_per_part: int = 1_000_000) -> DataFrame:
    """(kind, host, rank): ranks of every kind of ``seeds`` (kind, host, n) over ``edges`` (kind, src, dst, w).

    In each round a host keeps its share of the jumps and passes the rest of its rank along its edges by their weight;
    what comes to a host without edges is lost. Ranks start as the jumps and are shares of ``mass`` in whole numbers.
    Edges of a host with very many are dealt over parts, and summed by their end before they are shuffled.
    """
    total = seeds.agg(F.sum("n")).first()[0] or 1
    seeds = stored(seeds.select("kind", "host", F.floor(F.lit(float(mass)) * (F.col("n") / F.lit(float(total)))).alias("seed")))
    parts = max(1, -(-edges.count() // rows_per_part))
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    edges = stored(lookup(edges, out, ["kind", "src"], ["dst"], parts).select("kind", "src", "dst", (F.col("w") / F.col("all")).alias("share")))
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    for done in range(1, rounds + 1):
        sent = lookup(edges, ranks.withColumnRenamed("host", "src"), ["kind", "src"], ["dst"], parts).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.floor(F.col("rank") * F.col("share"))).alias("got"))
        jump, got = (F.coalesce(F.col(c), F.lit(0)) for c in ("seed", "got"))
        ranks = seeds.join(sent, ["kind", "host"], "full").select("kind", "host", (F.floor(jump * F.lit(1 - damping)) + F.floor(got * F.lit(damping))).alias("rank"))
        if done % rounds_at_once == 0 or done == rounds:
            ranks = stored(ranks)
    return ranks


def host_verdicts(pages: DataFrame, share: int = 50, least: float = 0.01, mass: int = 10**15) -> DataFrame:
    """(host, n_pages, trust, distrust, verdict) of the hosts of ``pages`` (host, verdict, html), where verdict is a rule's or null.

    A host is blocked where distrust makes up at least ``share`` hundredths of trust and distrust together, and comes to
    at least ``least`` of what a blocked page starts with, for each of its pages; else it is allowed, as one is that
    neither reaches.
    """
    pages = pages.where("host <> ''")
    counted = stored(pages.groupBy("host").agg(F.count("*").alias("n_pages"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")))
    seeds = counted.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "host", F.col("allowed").alias("n")), F.struct(F.lit("distrust").alias("kind"), "host", F.col("blocked").alias("n")))).alias("s")).select("s.*").where("n > 0")
    links = stored(host_edges(pages))
    ways = links.withColumn("kind", F.lit("trust")).unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.lit("distrust").alias("kind")))
    ranks = propagate(seeds, ways, mass)
    total = seeds.agg(F.sum("n")).first()[0] or 1
    of = ranks.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0)).alias(k) for k in ("trust", "distrust")))
    found = counted.join(of, "host", "left").select("host", "n_pages", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("trust", "distrust")))
    bad = (F.col("distrust") > 0) & (100 * F.col("distrust") >= share * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") >= F.col("n_pages") * F.lit(least * mass / total))
    return stored(found.withColumn("verdict", F.when(bad, "block").otherwise("allow")))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows_per_part: int = 1_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    Null and strange urls have an empty host and path, no rule, and are allowed. Null pages have no links. Rows that
    share an id or url are judged each by itself. An empty table gives an empty result; other columns are left out.
    """
    named = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    rule, given = longest_rule(F.col("host"), F.col("path"), rules)
    named = named.select("page_id", "host", "path", rule.alias("rule"), given.alias("verdict"), "html")
    hosts = host_verdicts(named).where("verdict = 'block'").select("host", F.col("verdict").alias("found"))
    parts = max(1, -(-pages.count() // rows_per_part))
    rows = lookup(named.drop("html"), hosts, ["host"], ["page_id", "path"], parts, "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", "found", F.lit("allow")).alias("verdict"))
