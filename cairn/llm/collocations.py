"""Collocations: phrases of two to four words that occur together more than their parts, counted by suffix arrays.

Texts become shards of word ids of one language each. A shard sorts the beginnings of its suffixes by numpy prefix
doubling; runs of neighbours whose common prefix has n words (LCP intervals) are the n-grams with their counts, which
are summed over shards by key. A phrase can only be frequent if its parts are, so shards count pairs of words that are
frequent in all shards together, and longer phrases over pairs that are. What a shard learns from the others is only
what occurs in it, through joins; nothing is broadcast. Keys are numbers of words, not hashes, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import lookup, mix64, releasing, small, stored

#: Bytes: A-Z in lower case, ends of pieces as line feeds, tabs as spaces.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_ZSTD = pa.Codec("zstd", compression_level=1)
#: Stands for the end of a piece; no word has this byte.
_END = b"."


class _Ids(dict):
    """Numbers of words, from 1, in the order in which they first come; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _parts(data: bytes, most: int) -> Iterator[bytes]:
    """Stretches of about ``most`` bytes that end with a piece."""
    a = 0
    while a < len(data):
        b = len(data) if len(data) - a <= most else data.rfind(b"\n", a, a + most) + 1 or (data.find(b"\n", a + most) + 1 or len(data))
        yield data[a:b]
        a = b


def _pack(*columns: np.ndarray) -> bytes:
    """Whole numbers of equal length as bytes: planes of equal bytes stand together, which compresses them well."""
    table = np.stack([np.asarray(c, "<i8") for c in columns]) if len(columns) > 1 else np.asarray(columns[0], "<i4")[None]
    planes = np.ascontiguousarray(table.view(np.uint8).reshape(len(table), -1, table.itemsize).transpose(0, 2, 1))
    return len(table[0]).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes, columns: int) -> np.ndarray:
    """The columns, one a row, of what ``_pack`` made of them."""
    n, width = int.from_bytes(data[:8], "little"), 8 if columns > 1 else 4
    planes = np.frombuffer(_ZSTD.decompress(data[8:], n * columns * width, asbytes=True), np.uint8).reshape(columns, width, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f"<i{width}").reshape(columns, n).astype(np.int64)


class _Shard:
    def __init__(self) -> None:
        self.ids, self.runs, self.size = _Ids({_END: 0}), [], 0

    def add(self, part: bytes) -> None:
        words = (part + b"\n").replace(b"\n", b" . ").split()
        self.runs.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self, shard: int, lang: str) -> pa.RecordBatch:
        ids = np.concatenate(self.runs)
        counts = np.bincount(ids, minlength=len(self.ids))
        counts[0] = 0
        lists = [pa.ListArray.from_arrays([0, len(counts)], x) for x in (pa.array(list(self.ids), pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()))]
        row = [pa.array([shard], pa.int64()), pa.array([lang]), pa.array([int(counts.sum())], pa.int64()), pa.array([_pack(ids)], pa.binary())]
        return pa.RecordBatch.from_arrays([*row, *lists], names=["shard", "lang", "n", "ids", "words", "counts"])


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_words: int = 4_000_000, part_bytes: int = 4_000_000) -> DataFrame:
    """(shard, lang, n, ids, words, counts): a row for each shard, written to the shared folder.

    A shard holds up to about ``shard_words`` words and ends of pieces; very long texts are cut between pieces. Shards
    are made where the texts are read, so texts aren't shuffled.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filling: dict[str, _Shard] = {}
        first = TaskContext.get().partitionId() << 32
        numbers = iter(range(first, first + (1 << 32)))
        for batch in batches:
            for rows in small(batch):
                texts: dict[str, list[bytes]] = {}
                for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    texts.setdefault(lang, []).append(text.encode())
                for lang, own in texts.items():
                    for part in _parts(b"\n".join(own).translate(_BYTES), part_bytes):
                        filling.setdefault(lang, _Shard()).add(part)
                        if filling[lang].size >= shard_words:
                            yield filling.pop(lang).row(next(numbers), lang)
                        elif sum(s.size for s in filling.values()) >= 2 * shard_words:
                            largest = max(filling, key=lambda x: filling[x].size)
                            yield filling.pop(largest).row(next(numbers), largest)
        for lang, shard in filling.items():
            yield shard.row(next(numbers), lang)

    texts = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string"))
    return stored(texts.mapInArrow(releasing(task), "shard long, lang string, n long, ids binary, words array<string>, counts array<long>"))


def suffix_array(words: np.ndarray, linked: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` words, the lengths of prefixes shared with the one before, and their own lengths.

    ``linked`` says of each word whether the next one may follow it in a phrase; a suffix ends where that is not so, or
    after ``depth`` words. Only suffixes of two words or more are sorted.
    """
    n = len(words)
    room, chain = np.ones(n, np.int64), linked.copy()
    for k in range(1, depth):
        room += chain
        chain[: max(0, n - k)] &= linked[k:]
        chain[max(0, n - k) :] = False
    rank, k = words.astype(np.int64), 1
    while k < depth:
        second = np.append(rank[k:], np.zeros(min(k, n), np.int64))
        second[room <= k] = 0
        key = rank * (int(rank.max(initial=0)) + 1) + second
        if 2 * k < depth:
            rank = np.unique(key, return_inverse=True)[1] + 1
        k *= 2
    at = np.flatnonzero(room > 1)
    at = at[np.argsort(key[at], kind="stable")]
    shared, same = np.zeros(len(at), np.int64), np.ones(max(0, len(at) - 1), bool)
    for j in range(depth):
        a, b = at[1:], at[:-1]
        same &= (room[a] > j) & (room[b] > j)
        same[same] = words[a[same] + j] == words[b[same] + j]
        shared[1:] += same
    return at, shared, room


def intervals(at: np.ndarray, shared: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an n-gram begins, for each different one, and how often it occurs: the intervals of suffixes that share n words."""
    begins = np.flatnonzero(shared < n)
    counts = np.diff(np.append(begins, len(at)))
    long_enough = room[at[begins]] >= n
    return at[begins][long_enough], counts[long_enough]


def _local(shard: pa.Table, known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The shard's word ids, and the number over all shards of each id (-1 for words that aren't frequent)."""
    ids = _unpack(shard["ids"][0].as_py(), 1)[0]
    numbers = np.full(int(ids.max(initial=0)) + 1, -1, np.int64)
    numbers[np.asarray(known["a"])] = np.asarray(known["b"])
    return ids, numbers


_CHUNK = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("chunk", pa.binary())])


def _pair_counter(buckets: int):
    """Counts of pairs of frequent words in a shard, a chunk (two numbers and a count each) for each bucket of pairs."""

    def count(shard: pa.Table, known: pa.Table) -> pa.Table:
        if not len(shard) or not len(known):
            return _CHUNK.empty_table()
        ids, numbers = _local(shard, known)
        fine = numbers[ids] >= 0
        linked = np.append(fine[1:], False) & fine
        begin, counts = intervals(*suffix_array(ids, linked, 2), 2)
        rows = np.stack((numbers[ids[begin]], numbers[ids[begin + 1]], counts))
        bucket = (mix64(mix64(rows[0].astype(np.uint64)) + rows[1].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        rows = rows[:, order := np.lexsort((rows[1], rows[0], bucket))]
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        chunks = [_pack(*part) for part in np.split(rows, cuts[1:], axis=1)] if len(cuts) else []
        return pa.table([bucket[order][cuts], np.full(len(cuts), shard["shard"][0].as_py(), np.int64), pa.array(chunks, pa.binary())], schema=_CHUNK)

    return count


def _pair_merger(least: int):
    """The frequent pairs of a bucket: with their counts over all shards as a chunk without a shard, and to each shard those that it has."""

    def merge(key: tuple, held: pa.Table) -> pa.Table:
        parts = [_unpack(c, 3) for c in held["chunk"].to_pylist()]
        rows = np.concatenate(parts, axis=1)
        shard = np.repeat(np.asarray(held["shard"]), [p.shape[1] for p in parts])
        order = np.lexsort((rows[1], rows[0]))
        rows, shard = rows[:, order], shard[order]
        begins = np.flatnonzero(np.append(True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)))
        counts = np.add.reduceat(rows[2], begins)
        often = counts >= least
        mine = np.repeat(often, np.diff(np.append(begins, rows.shape[1])))
        rows, shard = np.concatenate((np.stack((*rows[:2, begins[often]], counts[often])), rows[:, mine]), axis=1), np.concatenate((np.full(often.sum(), -1), shard[mine]))
        order = np.argsort(shard, kind="stable")
        rows, shard = rows[:, order], shard[order]
        cuts = np.flatnonzero(np.diff(shard, prepend=-2))
        chunks = [_pack(*part) for part in np.split(rows, cuts[1:], axis=1)] if len(cuts) else []
        return pa.table([np.full(len(cuts), key[0].as_py(), np.int64), shard[cuts], pa.array(chunks, pa.binary())], schema=_CHUNK)

    return merge


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpack(chunk, 3)], names=["g1", "g2", "f"])


def _count_phrases(shard: pa.Table, known: pa.Table) -> pa.Table:
    """Counts of phrases of three and four words of which each two neighbours are a frequent pair. ``known``: an id with its number, or a chunk of pairs."""
    schema = pa.schema([("g1", pa.int64()), ("g2", pa.int64()), ("g3", pa.int64()), ("g4", pa.int64()), ("c", pa.int64())])
    chunks = known["chunk"].drop_null().to_pylist()
    if not len(shard) or not chunks:
        return schema.empty_table()
    ids, numbers = _local(shard, known.filter(pc.is_null(known["chunk"])))
    pairs = np.concatenate([_unpack(c, 3)[:2] for c in chunks], axis=1)
    order = np.argsort(numbers, kind="stable")
    first, second = (order[np.searchsorted(numbers[order], x)] for x in pairs)
    frequent, size = np.sort(first * len(numbers) + second), len(numbers)
    keys = ids[:-1] * size + ids[1:]
    at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
    linked = np.append(frequent[at] == keys, False)
    sorted_ = suffix_array(ids, linked, 4)
    out = []
    for n in (3, 4):
        begin, counts = intervals(*sorted_, n)
        out.append(pa.table([*(numbers[ids[begin + j]] if j < n else np.full(len(begin), -1, np.int64) for j in range(4)), counts], schema=schema))
    return pa.concat_tables(out)


def frequent_phrases(cut: DataFrame, least: int = 30, words_per_bucket: int = 2_000_000) -> DataFrame:
    """(g, f, lang, word): words and phrases of up to four words that occur ``least`` times or more in a language.

    ``g`` lists the numbers of a phrase's words, which each language has for itself; lang and word are set for single
    words alone. Pairs meet in buckets by a hash, of about ``words_per_bucket`` words of the texts each, as packed chunks;
    with very many shards a chunk holds few pairs and costs what rows would, never more than one a pair.
    """
    each = cut.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("a", "w")).select("shard", "lang", "a", "w.*").where("counts > 0")
    words = each.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    words = stored(words.withColumn("b", F.monotonically_increasing_id()))
    known = stored(each.join(words.withColumnRenamed("word", "words"), ["lang", "words"]).select("shard", F.col("a").cast("long").alias("a"), "b"))
    blobs = cut.select("shard", "ids")
    buckets = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // words_per_bucket))
    counted = blobs.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_pair_counter(buckets), "bucket long, shard long, chunk binary")
    merged = stored(counted.groupBy("bucket").applyInArrow(_pair_merger(least), "bucket long, shard long, chunk binary"))
    twos = merged.where("shard < 0").select("chunk").mapInArrow(_pair_rows, "g1 long, g2 long, f long")
    present = merged.where("shard >= 0").select("shard", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "chunk")
    told = known.withColumn("chunk", F.lit(None).cast("binary")).unionByName(present)
    more = blobs.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_count_phrases, "g1 long, g2 long, g3 long, g4 long, c long")
    more = more.groupBy("g1", "g2", "g3", "g4").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    grams = twos.select(F.array("g1", "g2").alias("g"), "f").unionByName(more.select(F.filter(F.array("g1", "g2", "g3", "g4"), lambda x: x >= 0).alias("g"), "f"))
    single = words.select(F.array("b").alias("g"), "f", "lang", "word")
    return stored(single.unionByName(grams, allowMissingColumns=True))


def score(phrases: DataFrame, share: int = 80, rows_per_part: int = 1_000_000) -> DataFrame:
    """(g, a, l, r, score) of the phrases of ``frequent_phrases`` that no longer one stands for.

    A phrase is scored at the cut that gives the lowest floor(2000000 a / (l + r)), the first of equal ones. It is dropped
    where a longer phrase around it, dropped or not, has at least ``share`` hundredths of its count.
    """
    known = phrases.select(F.col("g").alias("part"), F.col("f").alias("n"))
    found = phrases.where("size(g) > 1").select("g", F.col("f").alias("a"))
    parts = max(1, -(-found.count() // rows_per_part))
    cuts = found.select("g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    sides = cuts.select("g", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("left"), F.slice("g", F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), F.slice("g", F.col("k") + 1, F.size("g") - F.col("k")).alias("part")))).alias("s")).select("g", "a", "k", "s.*")
    sides = lookup(sides, known, ["part"], ["g", "k"], parts).groupBy("g", "a", "k").agg(F.max(F.when(F.col("left"), F.col("n"))).alias("l"), F.max(F.when(~F.col("left"), F.col("n"))).alias("r"))
    value = F.expr("(CAST(a AS DECIMAL(19, 0)) * 2000000) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    lowest = sides.groupBy("g", "a").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("m")).select("g", "a", "m.l", "m.r", "m.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("g") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("g") - n + 1), lambda k: F.slice("g", k, n))))
    around = found.where("size(g) > 2").select(F.explode(inner).alias("g"), F.col("a").alias("longer")).groupBy("g").agg(F.max("longer").alias("longer"))
    covered = F.expr(f"longer IS NOT NULL AND CAST(longer AS DECIMAL(19, 0)) * 100 >= CAST(a AS DECIMAL(19, 0)) * {int(share)}")
    return lowest.join(around, "g", "left").where(~covered).drop("longer")


def top_collocations(docs: DataFrame, least: int = 30, most: int = 2000, share: int = 80, shard_words: int = 4_000_000, rows_per_part: int = 1_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` collocations of each language.

    Texts are read whole; A-Z is lower-cased; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. n counts
    all words of a language. Null texts and texts without a word have nothing to count; a null language is ``und``. Equal
    scores are ordered by count, then by the phrase's bytes. Repeated rows count each by itself; ids aren't read. Very
    long texts are cut between pieces. An empty table, or one without a phrase that is frequent enough, gives no row.
    """
    cut = shards(docs, shard_words=shard_words)
    phrases = frequent_phrases(cut, least)
    scored = stored(score(phrases, share, rows_per_part))
    parts = max(1, -(-scored.count() // rows_per_part))
    spelled = scored.select("*", F.posexplode("g").alias("p", "b"))
    words = phrases.where("word IS NOT NULL").select(F.col("g")[0].alias("b"), "lang", "word")
    spelled = lookup(spelled, words, ["b"], ["g", "p"], parts).groupBy("g", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    total = cut.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
