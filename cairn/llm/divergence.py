"""Quality rule: divergence of character-class and common-word histograms from language references.

Everything runs as DataFrame expressions. A document is one row throughout; nothing but the references is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACE_WORD

#: Common words of each language. Fixed values; their frequencies are measured on the corpus.
COMMON_WORDS = {
    "en": "the of and to in is on with that by are for it be was at as he this from or an not but".split(),
    "fr": "le la les de des du et en un une que qui dans par sur pour au aux est il elle ne pas plus".split(),
    "de": "der die das und in von zu den mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "es": "el la los las de del y en un una que por con para se su al lo como es no más o sus".split(),
}
#: Character classes in the order in which they are counted; what none of them holds is the last class.
CHARACTER_CLASSES = {"lower": r"\p{Ll}+", "space": r"[\x20\x09-\x0D]+", "upper": r"\p{Lu}+", "digit": r"\p{N}+", "mark": r"[.,;:!?'\"()\-]+", "symbol": r"[#*$%&|<>]+"}
CLASS_NAMES = [*CHARACTER_CLASSES, "other"]


@dataclass(frozen=True)
class Limits:
    """Farthest Jensen-Shannon distances (base 2, 0 to 1) of a kept text, and the least sizes at which they are judged."""

    characters: float = 0.25
    words: float = 0.3
    least_characters: int = 200
    least_words: int = 80


def _common_runs(docs: DataFrame, text: Column, names: list[str]) -> DataFrame:
    """Adds letter_words (long) and runs: an array of (w, n) with the count of each common word that occurs."""
    parts = F.split(F.lower(text), r"[^\p{L}]+")
    out = docs.withColumn("_parts", parts)
    out = out.withColumn("letter_words", F.size(F.filter("_parts", lambda w: w != "")).cast("long"))
    out = out.withColumn("_common", F.sort_array(F.filter("_parts", lambda w: w.isin(names))))
    out = out.withColumn("_starts", F.array_compact(F.transform("_common", lambda w, i: F.when(F.coalesce(F.get("_common", i - 1) != w, F.lit(True)), i))))
    runs = F.transform("_starts", lambda s, j: F.struct(F.get("_common", s).alias("w"), (F.coalesce(F.get("_starts", j + 1), F.size("_common")) - s).cast("long").alias("n")))
    return out.withColumn("runs", runs).drop("_parts", "_common", "_starts")


def _class_counts(docs: DataFrame, text: Column) -> DataFrame:
    """Adds one long column c_<class> for each character class, in code points."""
    out, names = docs.withColumn("_rest0", text), []
    for i, (name, pattern) in enumerate(CHARACTER_CLASSES.items()):
        out = out.withColumn(f"_rest{i + 1}", F.regexp_replace(f"_rest{i}", pattern, ""))
        out = out.withColumn(f"c_{name}", (F.length(f"_rest{i}") - F.length(f"_rest{i + 1}")).cast("long"))
        names.append(f"_rest{i}")
    last = f"_rest{len(CHARACTER_CLASSES)}"
    return out.withColumn("c_other", F.length(last).cast("long")).drop(*names, last)


def fit_references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", common_words: dict[str, list[str]] | None = None) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Language -> (shares of the character classes, shares of its common words among words), over all documents.

    Only languages with a word list have a reference; a few hundred sums reach the driver, whatever the input's size.
    Without any document of a language, it has no reference.
    """
    lists = common_words or COMMON_WORDS
    rows = docs.where(F.col(lang_col).isin(list(lists)) & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    chars = {r["l"]: [r[f"c_{c}"] for c in CLASS_NAMES] for r in _class_counts(rows, F.col("t")).groupBy("l").agg(*(F.sum(f"c_{c}").alias(f"c_{c}") for c in CLASS_NAMES)).collect()}
    names = sorted({w for x in lists.values() for w in x})
    # An empty string stands for every word, so that one pass gives the totals as well.
    words = rows.select("l", F.explode(F.split(F.lower("t"), r"[^\p{L}]+")).alias("w")).where("w <> ''").withColumn("w", F.when(F.col("w").isin(names), F.col("w")).otherwise(""))
    counts: dict[str, dict[str, int]] = {}
    for r in words.groupBy("l", "w").count().collect():
        counts.setdefault(r["l"], {})[r["w"]] = r["count"]
    out = {}
    for lang, c in chars.items():
        total, seen = max(sum(c), 1), counts.get(lang, {})
        n = max(sum(seen.values()), 1)
        out[lang] = ([x / total for x in c], {w: (seen.get(w, 0) + 0.5) / (n + 0.5 * len(lists[lang])) for w in lists[lang]})
    return out


def _term(x: Column, m: Column) -> Column:
    """x log2(x / m), 0 for x = 0."""
    return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))


def _distance(pairs: list[tuple[Column, Column]]) -> Column:
    total = F.lit(0.0)
    for p, q in pairs:
        m = (p + q) / 2
        total = total + _term(p, m) + _term(q, m)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _words_distance(shares: dict[str, float]) -> Column:
    """Distance of the runs' histogram from a reference over its words and one class for all others."""
    table = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
    known = F.filter(F.transform("runs", lambda r: F.struct((r["n"] / F.col("letter_words")).alias("p"), F.element_at(table, r["w"]).alias("q"))), lambda r: r["q"].isNotNull())
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def add(s: Column, r: Column) -> Column:
        m = (r["p"] + r["q"]) / 2
        return F.struct((s["d"] + r["p"] * F.log2(r["p"] / m) + r["q"] * F.log2(r["q"] / m)).alias("d"), (s["p"] + r["p"]).alias("p"), (s["q"] + r["q"]).alias("q"))

    covered = math.fsum(shares.values())

    def finish(s: Column) -> Column:
        p, q = F.greatest(1 - s["p"], F.lit(0.0)), F.lit(1 - covered)  # the words of no list
        absent = F.greatest(F.lit(covered) - s["q"], F.lit(0.0))  # q log2(q / (q / 2)) of words that do not occur
        return F.sqrt(F.greatest((s["d"] + absent + _term(p, (p + q) / 2) + _term(q, (p + q) / 2)) / 2, F.lit(0.0)))

    return F.aggregate(known, zero, add, finish)


def base_counts(docs: DataFrame, text: Column) -> DataFrame:
    """Adds n_words, word_chars, n_dup_lines, n_repeat_words (long); windows of three words are compared by 64-bit hashes within a text."""
    out = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(f"({SPACE_WORD})"), 1))
    out = out.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    out = out.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    head = F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0)))
    out = out.withColumn("_grams", F.transform(head, lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))))
    # Most texts repeat no window; only the others sort theirs, and then look at neighbours.
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    out = out.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False))
    out = out.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", same), lambda x: x["i"])))
    covered = F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - p, F.lit(3))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return out.drop("_words", "_lines", "_grams", "_sorted", "_at")


def judge(docs: DataFrame, references: dict[str, tuple[list[float], dict[str, float]]], limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, distances from the nearest reference, and the verdict, a row for each row.

    Returns the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ref_lang,
    char_distance, word_distance. A null text counts as empty and fails the base rule. A distance is null, and not
    judged, where the text is under its least size or there is no reference. Other columns are ignored, whatever
    their names; null and repeated ids stay as they are.
    """
    text = F.col("text")
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = base_counts(_class_counts(_common_runs(out, text, sorted({w for _, x in references.values() for w in x})), text), text).drop("text")
    out = out.withColumn("n_symbols", F.col("c_symbol"))
    out = out.withColumn("_chars", F.greatest(sum((F.col(f"c_{c}") for c in CLASS_NAMES), F.lit(0)), F.lit(1)))
    none = F.lit(None).cast("struct<w:double,c:double,l:string>")
    near = [
        F.when(F.col("letter_words") > 0, F.struct(_words_distance(words).alias("w"), _distance([(F.col(f"c_{c}") / F.col("_chars"), F.lit(q)) for c, q in zip(CLASS_NAMES, shares)]).alias("c"), F.lit(lang).alias("l")))
        for lang, (shares, words) in sorted(references.items())
    ]
    out = out.withColumn("_near", F.least(*near, none, none) if near else none)
    out = out.withColumn("word_distance", F.when(F.col("letter_words") >= limits.least_words, F.col("_near")["w"]))
    out = out.withColumn("char_distance", F.when(F.col("word_chars") >= limits.least_characters, F.col("_near")["c"]))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    far = F.coalesce(F.col("char_distance") > limits.characters, F.lit(False)) | F.coalesce(F.col("word_distance") > limits.words, F.lit(False))
    out = out.withColumn("kept", ~F.col("base_failed") & ~far)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(F.col("id").alias(id_col), *names, F.col("_near")["l"].alias("ref_lang"), "char_distance", "word_distance")
