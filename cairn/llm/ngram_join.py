"""Jaccard join of word n-gram sets by vertical partitioning of the global n-gram order.

N-grams are ordered: those that few documents hold first, by hash, then the frequent ones by frequency. Each set is
cut by that order. Its first part, the prefix, finds candidates: two sets that link share an n-gram of their prefixes,
and with it more than a fixed number of them. Which n-grams several prefixes hold is found on packs of them by range
of hashes; only those become rows. For candidates, the whole order is cut into fragments at fixed n-grams;
each fragment counts the overlap of its part of two sets, and the counts are summed per pair.

A group of near copies is never expanded into its pairs while one member can stand for it: pairs with the member of a
prefix group that has the fewest n-grams of its own are counted first, and after that only pairs across the
components that these links leave. Sets just below the similarity meet there without linking. A sketch rules them out
while they meet: the parities of a set's numbers of n-grams in 256 classes. Two sets differ in at least as many n-grams
as their sketches in bits, and the sizes say how many that may be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ensure_checkpoint_dir, gram_hashes, hash_words, mix64, releasing, slices, small, stored, texts_of
from cairn.llm.components import components

SLICE_CHARS = 500_000
#: Rows of which the n-grams that several hold are counted at a time.
COUNTED_ROWS = 5_000
FRAGMENTS = 8
#: N-grams of prefixes that a task packs at a time.
PACKED = 200_000
#: Sets that a task compares with the others of one n-gram; those of more are dealt. Changes the work, never a result.
SHARE = 1_000
#: Sets of an n-gram that meet in one task without being dealt.
FEW = 100


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-grams; a shorter text is one gram, an empty one has none."""
    words, counts = hash_words(texts, lower=True)
    grams, out, begin = gram_hashes(words, n), [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(grams[begin : begin + c - n + 1]))
        else:
            out.append(gram_hashes(words[begin : begin + c], c, 7) if c else np.zeros(0, np.uint64))
        begin += c
    return out


def set_key(grams: np.ndarray) -> int:
    """A 64-bit hash of a set; documents with equal sets are one class."""
    return int(mix64(np.array([np.add.reduce(mix64(grams ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def sketch(grams: np.ndarray) -> np.ndarray:
    """Four 64-bit values with the parity of the number of n-grams in each of 256 classes."""
    odd = np.bincount((mix64(grams + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Order:
    """The global order of n-grams: rare ones by hash, then the frequent ones, which are given in ascending order of frequency."""

    def __init__(self, frequent: np.ndarray) -> None:
        self.at = np.argsort(frequent)
        self.known = frequent[self.at]

    def _split(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rare n-grams, frequent ones, and the ranks of those."""
        if not len(self.known):
            return grams, grams[:0], np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        often = self.known[place] == grams
        rank = self.at[place[often]]
        late = np.argsort(rank)
        return grams[~often], grams[often][late], rank[late]

    def sort(self, grams: np.ndarray) -> np.ndarray:
        return np.concatenate(self._split(grams)[:2])

    def cut(self, grams: np.ndarray, fragments: int) -> list[np.ndarray]:
        """A sorted set, cut at the same n-grams as every other one: half of the cuts among the rare, half among the frequent."""
        rare, late, rank = self._split(grams)
        few, many = fragments - fragments // 2, fragments // 2
        at = np.arange(1, few, dtype=np.uint64) * np.uint64((1 << 64) // few)
        return [*np.split(rare, np.searchsorted(rare, at)), *np.split(late, np.searchsorted(rank, np.arange(1, many) * len(self.known) // many))]


def frequent_grams(docs: DataFrame, n: int, most: int) -> np.ndarray:
    """The ``most`` n-grams that most documents hold, in ascending order of that number.

    All documents count; a batch of them reports the n-grams that two or more of its documents hold. ``most`` bounds
    what is broadcast. This decides the order only, never a result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in small(b, COUNTED_ROWS)):
            texts = [(t or "").encode() for t in texts_of(batch)]
            parts = [np.concatenate(gram_sets(texts[a:b], n)) for a, b in slices(texts, SLICE_CHARS)]
            found, c = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            often = c >= 2
            yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(c[often].astype(np.int64))], ["gram", "c"])

    counted = docs.select("text").mapInArrow(releasing(count), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).where("c >= 4")
    rows = counted.orderBy(F.desc("c"), "gram").limit(most).toPandas()
    return rows.sort_values(["c", "gram"])["gram"].to_numpy(np.int64).view(np.uint64)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs: that width, then all first bytes, all second ones and so on."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def widen(packed: bytes) -> np.ndarray:
    """The numbers that ``narrow`` packed, as unsigned 64-bit ones."""
    width = packed[0]
    out = np.zeros(((len(packed) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u8").ravel()


PACK = "bucket int, least long, base long, grams binary, rows binary, places binary"
HELD = "key long, pos int, gram long"


def packs(keys: np.ndarray, prefixes: list[np.ndarray], buckets: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[tuple]]:
    """The n-grams of some prefixes: (prefix, pos, gram) of those that another one holds too, in order, and packs of all by range of hashes.

    A pack lists n-grams once each, in ascending order, as steps from the least one. With one that a single prefix
    holds go its row (its key less the base) and its place, counted from 1; place 0 tells that several hold it.
    """
    sizes = np.array([len(p) for p in prefixes], np.int64)
    grams = np.concatenate([np.zeros(0, np.uint64), *prefixes])
    row, pos = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if not len(grams):
        return (row, pos, grams.view(np.int64)), []
    base = int(keys.min())
    found, first, back, count = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
    several = count[back] > 1
    sure = row[several], pos[several], grams[several].view(np.int64)
    rows = np.where(count > 1, 0, keys[row[first]] - base)
    places = np.where(count > 1, 0, pos[first] + 1)
    bucket = ((found >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets).astype(bool))
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        out.append((int(bucket[a]), int(found[a].view(np.int64)), base, narrow(np.diff(found[a:b], prepend=found[a])), narrow(rows[a:b]), narrow(places[a:b])))
    return sure, out


def meet(table: pa.Table) -> pa.Table:
    """(key, pos, gram) of the n-grams that more than one of a bucket's packs hold and one row of its pack does."""
    column = lambda name: table.column(name).to_pylist()
    grams = np.concatenate([np.cumsum(widen(g), dtype=np.uint64) + np.int64(x).view(np.uint64) for g, x in zip(column("grams"), column("least"))])
    keys = np.concatenate([widen(r).astype(np.int64) + x for r, x in zip(column("rows"), column("base"))])
    places = np.concatenate([widen(p).astype(np.int64) for p in column("places")])
    _, back, count = np.unique(grams, return_inverse=True, return_counts=True)
    met = (count[back] > 1) & (places > 0)
    return pa.table({"key": keys[met], "pos": (places[met] - 1).astype(np.int32), "gram": grams[met].view(np.int64)})


def _signatures(docs: DataFrame, kind: str, n: int, percent: int, held, buckets: int) -> DataFrame:
    """(key, id, n, class, sketch, sure): a set, its sketch, and (pos, gram) of the prefix's n-grams that a set near it in its task holds too.

    Sketch and prefix are left out (null) where a task has met the class before, as far as a bounded memory tells. All
    n-grams of prefixes are in rows of their own, the packs, where only the columns of packs are filled.
    """
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("sketch", pa.list_(pa.int64())), ("sure", pa.list_(pa.struct([("pos", pa.int32()), ("gram", pa.int64())])))])
    pack = pa.schema([("bucket", pa.int32()), ("least", pa.int64()), ("base", pa.int64()), ("grams", pa.binary()), ("rows", pa.binary()), ("places", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, met = Order(held.value), set()
        for batch in (part for b in batches for part in small(b, COUNTED_ROWS)):
            keys, begin, waiting, rows = batch.column(0).to_numpy(), 0, 0, []

            def done(end: int) -> Iterator[pa.RecordBatch]:
                size, key, prefix, seen = (list(x) for x in zip(*rows))
                at = [i for i, p in enumerate(prefix) if p is not None]
                sure, packed = packs(keys[begin:end][at], [prefix[i] for i in at], buckets)
                count = np.zeros(len(rows), np.int64)
                count[at] = np.bincount(sure[0], minlength=len(at))
                told = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.StructArray.from_arrays([pa.array(sure[1], pa.int32()), pa.array(sure[2])], ["pos", "gram"]))
                ids = batch.column(1).slice(begin, end - begin)
                own = [pa.array(x, f.type) for x, f in zip((keys[begin:end], size, key, seen), schema)] + [told]
                names = ["key", "id", *schema.names[1:], *pack.names]
                yield pa.RecordBatch.from_arrays([own[0], ids, *own[1:], *(pa.nulls(len(rows), f.type) for f in pack)], names)
                if packed:
                    none = [pa.nulls(len(packed), f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays([none[0], pa.nulls(len(packed), ids.type), *none[1:], *(pa.array(x, f.type) for x, f in zip(zip(*packed), pack))], names)

            for part in small(batch):
                texts = [(t or "").encode() for t in texts_of(part)]
                if len(met) > 200_000:
                    met.clear()
                for a, b in slices(texts, SLICE_CHARS):
                    for grams in gram_sets(texts[a:b], n):
                        size = len(grams)
                        key = set_key(grams) if size else None
                        new = size > 0 and key not in met
                        if new:
                            met.add(key)
                        prefix = order.sort(grams)[: size - -(-percent * size // 100) + 1] if new else None
                        rows.append((size, key, prefix, sketch(grams) if new else None))
                        waiting += len(prefix) if new else 0
                    if waiting > PACKED:
                        yield from done(begin + len(rows))
                        begin, waiting, rows = begin + len(rows), 0, []
            if rows:
                yield from done(begin + len(rows))

    return docs.select("key", "id", "text").mapInArrow(releasing(sign), f"key long, id {kind}, n long, class long, sketch array<long>, sure array<struct<pos: int, gram: long>>, {PACK}")


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of linked sets of sizes a and b."""
    return F.ceil(percent * (a + b) / (100 + percent))


class _Join:
    def __init__(self, docs: DataFrame, kind: str, n: int, percent: int, frequent: int, broadcast_rows: int) -> None:
        self.docs, self.n, self.percent, self.broadcast_rows = docs, n, percent, broadcast_rows
        self.held = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs, n, frequent))
        buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        signed = _signatures(docs, kind, n, percent, self.held, buckets).checkpoint()
        self.members = signed.where("bucket IS NULL").select("key", "id", "n", "class")
        # N-grams are shuffled once, packed; rows of their own have only those that several prefixes hold.
        packed = signed.where("bucket IS NOT NULL").select(*(c.split()[0] for c in PACK.split(", ")))
        sure = signed.where("bucket IS NULL").select("key", F.inline("sure"))
        held = packed.groupBy("bucket").applyInArrow(meet, HELD).unionByName(sure).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "gram"))).alias("held"))
        # The row with the smallest key stands for its class. Keys are near each other, so they take fewer bytes than classes.
        once = signed.where("sketch IS NOT NULL").groupBy("class").agg(F.min(F.struct("key", "n", "sketch")).alias("_x")).select("class", "_x.*")
        # key, class, n, sketch, held, alone: the prefix grams of a class that several rows hold, in order
        self.sets = stored(once.join(held, "key").withColumn("alone", self.prefix(F.col("n")) - F.size("held")))
        self.parts = self.sets.select("key", F.col("held.gram").alias("grams"))

    def prefix(self, n: Column) -> Column:
        return n - F.ceil(self.percent * n / 100) + 1

    def fits(self, a: str, b: str) -> Column:
        return (100 * F.col(a) >= self.percent * F.col(b)) & (100 * F.col(b) >= self.percent * F.col(a))

    def alike(self, n: str, m: str, sketch: str, other: str) -> Column:
        """Whether two sets differ in no more bits of their sketches than linked sets of their sizes may in n-grams."""
        differ = sum((F.bit_count(F.col(sketch)[i].bitwiseXOR(F.col(other)[i])) for i in range(4)), F.lit(0))
        return self.fits(n, m) & (differ <= F.col(n) + F.col(m) - 2 * _needed(F.col(n), F.col(m), self.percent))

    def postings(self, sets: DataFrame) -> DataFrame:
        """A row for each of the ``held`` grams: gram, pos, and before, the gram that precedes it among them (null at the first)."""
        ahead = F.concat(F.array(F.lit(None).cast("long")), F.slice("held.gram", 1, F.size("held") - 1))
        told = sets.withColumn("before", ahead).withColumn("_x", F.explode(F.arrays_zip("held.gram", "held.pos", "before")))
        return told.select("_x.*", *(c for c in sets.columns if c != "held"))

    def led(self) -> DataFrame:
        """Candidates of each member of a prefix group with the member that has the fewest prefix grams of its own."""
        shared = self.postings(self.sets.select("key", "held", "alone")).drop("pos", "before")
        lead = shared.groupBy("gram").agg(F.min(F.struct("alone", "key")).alias("lead"))
        met = shared.join(lead, "gram").select("key", F.col("lead.key").alias("other")).where("key <> other").distinct()
        one = self.sets.select("key", "n", "sketch")
        two = one.select(F.col("key").alias("other"), F.col("n").alias("m"), F.col("sketch").alias("seen"))
        pairs = met.join(one, "key").join(two, "other").where(self.alike("n", "m", "sketch", "seen"))
        return self.ordered(pairs.select("key", "n", "other", "m"))

    def across(self, roots: DataFrame) -> DataFrame:
        """Candidates in different components: the longer set's prefix against the shorter one's index prefix.

        A linked pair meets at its first common n-gram in any case. So a pair is left out at an n-gram after which too few
        remain of either set, and where both sets hold the same n-gram just before, since it isn't the first one then.
        Near sets that share many n-grams in a row leave few rows, not one for each.

        Sets of an n-gram that few hold meet without being dealt or stored before. Those of the others are dealt, if they
        are of several components.
        """
        # Of stored tables Spark knows the size, so it sends small ones to the sets instead of shuffling these.
        often = stored(self.sets.select(F.explode("held.gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > FEW).select("gram"))
        often = F.broadcast(often) if often.count() <= self.broadcast_rows else often
        labelled = self.postings(self.sets.drop("class", "alone").join(stored(roots.select(F.col("node").alias("key"), "root")), "key", "left").withColumn("root", F.coalesce("root", "key")))
        labelled = labelled.select("gram", "before", "key", "n", "pos", "root", "sketch")
        other = lambda rows: rows.select("gram", F.col("before").alias("ahead"), F.col("key").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("root").alias("far"), F.col("sketch").alias("seen"), *(c for c in ("salts",) if c in rows.columns))
        indexed = F.col("pos") <= F.col("n") - F.ceil(2 * self.percent * F.col("n") / (100 + self.percent))
        needed = _needed(F.col("n"), F.col("m"), self.percent)
        first = F.expr("before IS NULL OR ahead IS NULL OR before <> ahead") & (F.col("pos") <= F.col("n") - needed) & (F.col("at") <= F.col("m") - needed)
        kept = F.expr("root <> far AND (n < m OR n = m AND key < other)") & first & self.alike("n", "m", "sketch", "seen")
        few = labelled.join(often, "gram", "left_anti")
        pairs = few.where(indexed).join(other(few), "gram").where(kept).select("key", "n", "other", "m")

        many = labelled.join(often, "gram", "left_semi")
        several = many.groupBy("gram").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.ceil(F.count("*") / SHARE).cast("int").alias("salts")).where("least <> most").select("gram", "salts")
        left = many.join(several, "gram").checkpoint()
        index = left.where(indexed).withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")).drop("salts")
        long = other(left).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        dealt = index.join(long, ["gram", "salt"]).where(kept).select("key", "n", "other", "m")
        return self.ordered(pairs.unionByName(dealt))

    def ordered(self, pairs: DataFrame) -> DataFrame:
        swap = F.col("key") > F.col("other")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        pairs = pairs.where(self.fits("n", "m")).select(pick("key", "other").alias("a"), pick("n", "m").alias("n_a"), pick("other", "key").alias("b"), pick("m", "n").alias("n_b"))
        return pairs.dropDuplicates(["a", "b"])

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link. First the prefixes' overlap must leave it possible; then all fragments are counted."""
        parts = lambda x: self.parts.select(F.col("key").alias(x), F.col("grams").alias(f"g_{x}"))
        both = pairs.join(parts("a"), "a").join(parts("b"), "b")
        # Of two prefixes, one ends first in the order; beyond it, that set has only its rest to offer.
        rest = F.greatest(F.col("n_a") - self.prefix(F.col("n_a")), F.col("n_b") - self.prefix(F.col("n_b")))
        likely = both.where(F.size(F.array_intersect("g_a", "g_b")) + rest >= _needed(F.col("n_a"), F.col("n_b"), self.percent)).select("a", "n_a", "b", "n_b").checkpoint()
        fragments = self.fragments(likely.select(F.col("a").alias("key")).unionByName(likely.select(F.col("b").alias("key"))).distinct())
        side = lambda x: fragments.select(F.col("key").alias(x), "fragment", F.col("grams").alias(f"g_{x}"))
        # Both sides meet by set and fragment, so they may share one shuffle of fragments.
        asked = likely.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
        counted = asked.join(side("a"), ["a", "fragment"]).join(side("b"), ["b", "fragment"]).withColumn("overlap", F.size(F.array_intersect("g_a", "g_b")))
        summed = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
        return summed.where(100 * F.col("overlap") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")

    def fragments(self, wanted: DataFrame) -> DataFrame:
        """(key, fragment, grams) of the wanted sets."""
        few = wanted.limit(self.broadcast_rows + 1).count() <= self.broadcast_rows
        n, held, texts = self.n, self.held, self.docs.select("key", "text").join(F.broadcast(wanted) if few else wanted, "key")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order = Order(held.value)
            for batch in (part for b in batches for part in small(b)):
                texts, rows = [(t or "").encode() for t in texts_of(batch)], iter(batch.column(0).to_pylist())
                keys, numbers, parts = [], [], []
                for a, b in slices(texts, SLICE_CHARS):
                    for grams, key in zip(gram_sets(texts[a:b], n), rows):
                        for i, part in enumerate(order.cut(grams, FRAGMENTS)):
                            if len(part):
                                keys.append(key), numbers.append(i), parts.append(part.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["key", "fragment", "grams"])

        return texts.select("key", "text").mapInArrow(releasing(cut), "key long, fragment int, grams array<long>")

    def labelled(self, roots: DataFrame) -> DataFrame:
        """(class, root) of the linked classes; root is a class."""
        names = self.sets.select("key", "class")
        ends = names.select(F.col("key").alias("root"), F.col("class").alias("far"))
        return roots.withColumnRenamed("node", "key").join(names, "key").join(ends, "root").select("class", F.col("far").alias("root"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1_000_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Components of documents whose sets of word n-grams have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs without ASCII white space, A-Z in lower case. Returns a row for each row: the id, n_shingles,
    component_id (the smallest id of the component). Texts that are null or have no word have an empty set and link
    with nothing; a null id is never the smallest one unless all are null. Equal sets are one class from the start, so
    copies cost nothing; all links between classes that can change a component are counted exactly, on 64-bit hashes of
    the n-grams. Null and repeated ids are rows like any other, and other columns are ignored, whatever their names. The
    input must be a table or otherwise give its rows in the same order when it is read again.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    join = _Join(docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), kind, n, percent, frequent, broadcast_rows)
    links = join.linked(join.led()).checkpoint()
    roots = components(links)
    more = join.linked(join.across(roots)).checkpoint()
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    members = join.members.join(join.labelled(roots), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = members.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"))
    out = members.join(least, "root", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
