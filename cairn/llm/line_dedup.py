"""Line dedup by a segment-partition edit join.

A line within ``tau`` edits of another contains one of the other's tau + 1 segments unchanged, near its place. Segments
of all lines are the index; a line probes it with those of its substrings that can match, by length and place. What
meets is verified by a banded bit-parallel edit distance. Short lines may differ by fewer edits, the shortest by none:
those meet by their hash alone.

Lines made from one pattern share segments without being near. So each line has a sketch: a bit for each of 64 classes
of its pairs of neighbouring characters, set where their number is odd. An edit changes four of those pairs at most,
so sketches that differ in more bits than four an edit rule a pair out while the index is probed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Sums, ensure_checkpoint_dir, mix64, releasing, small, texts_of

_BLANK = " \t\n\r\x0b\x0c"
SLICE_CHARS = 500_000
#: Lines that a task remembers; a key is hot with more than HOT rows and more than one of HOT_KEYS of all. They change the work, never a result.
MET, HOT, HOT_KEYS = 200_000, 1_000, 1_000


def key_of(line: str) -> str:
    """What lines are compared by: without the white space at their ends."""
    return line.strip(_BLANK)


def long_hash(text: str, seed: int = 0) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode(), seed)
    return h - (1 << 64) if h >> 63 else h


def segment(length: np.ndarray, most: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of segment i of most + 1, which differ in size by one at most, the shorter ones first."""
    size, longer = np.divmod(length, most + 1)
    shorter = most + 1 - longer
    return i * size + np.maximum(i - shorter, 0), size + (i >= shorter)


def edits(length, tau: int, least: int):
    """The edits by which a line may differ from another one that isn't shorter: tau from ``least`` code points on, below in proportion."""
    return np.where(np.asarray(length) >= least, tau, np.asarray(length) * tau // max(least, 1))


def _mixed(codes: np.ndarray) -> np.ndarray:
    return mix64((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_PLANE = _mixed(np.arange(1 << 16))


def code_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each code point; those of the basic plane are looked up."""
    if not len(codes) or codes.max() < len(_PLANE):
        return _PLANE[codes]
    out, far = _PLANE[np.minimum(codes, len(_PLANE) - 1)], codes >= len(_PLANE)
    out[far] = _mixed(codes[far])
    return out


class LineKeys:
    """Keys of the segments and substrings of several lines, as arrays of (line, key), and the lines' sketches."""

    def __init__(self, lines: list[str], tau: int, least: int = 0) -> None:
        self.hashes = code_hashes(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32))
        self.tau, self.least, self.sums = tau, least, Sums(self.hashes)
        self.length = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.cumsum(self.length) - self.length

    def _keys(self, of: np.ndarray, begin: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        place = self.start[of] + begin
        tag = (length * 64 + i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return of, mix64(self.sums.of(place, place + size) ^ tag)

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        most, found = edits(self.length, self.tau, self.least), []
        for m in range(1, self.tau + 1):
            of = np.flatnonzero(most == m)
            length = self.length[of]
            found += [self._keys(of, *segment(length, m, i), length, i) for i in range(m + 1)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the substrings that may equal a segment of a line that is as long or up to tau shorter.

        With the segment at i unchanged, its left side may hold i edits and its right side the rest; the shift of its
        place is bounded from both ends.
        """
        found = []
        for gap in range(self.tau + 1):
            most = edits(self.length - gap, self.tau, self.least)
            for m in range(max(gap, 1), self.tau + 1):
                of = np.flatnonzero((most == m) & (self.length >= gap))
                length = self.length[of] - gap
                for i in range(m + 1):
                    begin, size = segment(length, m, i)
                    for shift in range(max(-i, gap - (m - i)), min(i, gap + (m - i)) + 1):
                        fits = (begin + shift >= 0) & (begin + shift + size <= self.length[of])
                        found.append(self._keys(of[fits], (begin + shift)[fits], size[fits], length[fits], i))
        return tuple(np.concatenate(x) for x in zip(*found))

    def sketches(self) -> np.ndarray:
        """Parities of the numbers of neighbouring pairs of characters, by class of pair; of lines that aren't empty."""
        bits = np.zeros(len(self.hashes), np.uint64)
        # Hashes are mixed already, so the upper bits of a sum of them are as good as any.
        np.left_shift(np.uint64(1), (self.hashes[:-1] * np.uint64(0xA0761D6478BD642F) + self.hashes[1:]) >> np.uint64(58), out=bits[:-1])
        bits[self.start + self.length - 1] = 0
        return np.bitwise_xor.reduceat(bits, self.start) if len(bits) else bits


def index_keys(line: str, tau: int, least: int = 0) -> list[int]:
    return LineKeys([line], tau, least).index()[1].tolist()


def probe_keys(line: str, tau: int, least: int = 0) -> list[int]:
    return LineKeys([line], tau, least).probes()[1].tolist()


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance of a and b is tau at most: bit vectors over a band of 2 tau + 1 diagonals."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > tau:
        return False
    if len(a) <= tau:
        return True
    # Bit t of column j stands for row j - tau + t; the last bit is the lowest diagonal. plus and minus are the vertical
    # differences; those of the rows of a that exist before the first column are +1.
    width = 2 * tau + 1
    mask, last, places = (1 << width) - 1, 1 << (width - 1), {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + tau)
    plus, minus, distance, step = mask ^ ((1 << tau) - 1), 0, tau, last >> 1
    on_diagonal, worst = len(a) - tau, 2 * tau + len(b) - len(a)
    for j, c in enumerate(b):
        match = (places.get(c, 0) >> j) & mask
        zero = (((match & plus) + plus) ^ plus) | match | minus
        right, left = (minus | ~(zero | plus)) & mask, zero & plus
        if j < on_diagonal:
            distance += not zero & last
        else:  # past the last row, the distance is followed along it
            distance += bool(right & step) - bool(left & step)
            step >>= 1
        if distance > worst:
            return False
        down = (zero & mask) >> 1
        plus, minus = (left | ~(down | right)) & mask, down & right
    return distance <= tau


def dealt(of: np.ndarray, part: np.ndarray, lines: np.ndarray, hot: np.ndarray, salts: np.ndarray, probes: bool) -> tuple[np.ndarray, np.ndarray]:
    """The arrays (line, key) with hot keys dealt: such a key becomes one of several by a hash of the line, for probes all of them."""
    if not len(hot):
        return of, part
    place = np.minimum(np.searchsorted(hot, part.view(np.int64)), len(hot) - 1)
    times = np.where(hot[place] == part.view(np.int64), salts[place], 1)
    if probes:
        at = np.repeat(np.arange(len(part)), times)
        salt = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        of, part = of[at], part[at]
    else:
        salt = mix64(lines[of].view(np.uint64)) % times.astype(np.uint64)
    salt = salt.astype(np.uint64)
    return of, np.where(salt > 0, mix64(part ^ salt * np.uint64(0x9E3779B97F4A7C15)), part)


def _salt(of: Column) -> Column:
    """A number below ``salts``, by row; 0 where the key isn't hot."""
    return F.coalesce(F.pmod(F.xxhash64(of), F.col("salts")), F.lit(0)).cast("int")


def _salts() -> Column:
    return F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)


def _lines(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, str]]]]]:
    """Batches with the (number, key) of the lines of each text that have ``least`` code points or more."""
    for batch in (part for b in batches for part in small(b)):
        yield batch, [[(i, k) for i, k in enumerate(map(key_of, (t or "").split("\n"))) if len(k) >= least] for t in texts_of(batch)]


def dedup_lines(docs: DataFrame, tau: int = 2, least: int = 24, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = (), broadcast_rows: int = 1_000_000) -> DataFrame:
    """Remove lines that an earlier line of the corpus equals or nearly equals.

    Lines are split at \\n and compared without the white space at their ends. All but blank ones are judged: one is
    removed if an earlier one equals it or is within the edits that the shorter of the two admits, be that one removed
    itself or not. From ``least`` code points on that are ``tau`` edits, below in proportion (at 24 and 2: one edit from
    12 code points on, none below). Earlier means a smaller id, of equal ids an earlier row, then a smaller line number;
    null ids come first.

    Returns a row for each row: the id, n_lines, n_judged, n_removed, n_near (removed, and unlike every earlier line),
    kept_sha256 (of the kept lines joined by \\n) and, if asked for, kept_text, and the columns named in ``carry``. A null text is one empty line. Other
    columns are ignored, whatever their names. The input must be a table or otherwise give its rows in the same order
    when it is read again.

    Equal lines are one class, by a 128-bit hash, before anything is joined. Links are kept between classes only. Keys
    that hold more than a share of all rows are few by definition; their rows are dealt over several tasks.
    """
    if least <= tau:
        raise ValueError("lines that are judged must be longer than tau")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _lines(batches):
            of = [r for r, found in enumerate(rows) for _ in found]
            flat = [x for found in rows for x in found]
            at = pa.array(of, pa.int32())
            columns = [pa.array([long_hash(k) for _, k in flat], pa.int64()), pa.array([long_hash(k, 1) for _, k in flat], pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array([i for i, _ in flat], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["line", "check", "key", "id", "number"])

    lines = keyed.mapInArrow(releasing(occur), f"line long, check long, key long, id {kind}, number int")
    first = lines.groupBy("line", "check").agg(F.count("*").alias("c"), F.min(F.struct("id", "key", "number")).alias("first")).checkpoint()

    shortest = -(-least // max(tau, 1))  # of the lines that may differ by an edit

    def unmet(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int]]]:
        """Lines that may differ by an edit, each once as far as a bounded memory tells, and their hashes."""
        met: set[int] = set()
        for _, rows in _lines(batches, shortest):
            fresh, held = {}, 0
            for k in (k for r in rows for _, k in r):
                h = long_hash(k)
                if h not in met:
                    met.add(h)
                    fresh[h] = k
                    held += len(k)
                    if held > SLICE_CHARS:
                        yield list(fresh.values()), list(fresh)
                        fresh, held = {}, 0
            if fresh:
                yield list(fresh.values()), list(fresh)
            if len(met) > MET:
                met.clear()

    def cut(batches: Iterator[pa.RecordBatch], side: str) -> Iterator[pa.RecordBatch]:
        for found, hashes in unmet(batches):
            keys, lines = LineKeys(found, tau, least), np.array(hashes, np.int64)
            of, part = getattr(keys, side)()
            of, part = dealt(of, part, lines, *held.value, side == "probes")
            yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(lines[of]), pa.array(keys.sketches().view(np.int64)[of])], ["part", "line", "sketch"])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments that several lines of a slice have, with their number, and under part null the number of all."""
        for found, _ in unmet(batches):
            part, c = np.unique(LineKeys(found, tau, least).index()[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*part[c > 3].view(np.int64).tolist(), None], pa.int64()), pa.array([*c[c > 3].tolist(), int(c.sum())], pa.int64())], ["part", "c"])

    text = keyed.select("text")
    counted = text.mapInArrow(releasing(often), "part long, c long").groupBy("part").agg(F.sum("c").alias("c")).checkpoint()
    every = counted.where("part IS NULL").agg(F.sum("c")).first()[0] or 0
    share = max(HOT, every // HOT_KEYS)  # so at most HOT_KEYS segments have more
    hot = counted.where(F.col("part").isNotNull() & (F.col("c") > share)).select("part", F.ceil(F.col("c") / share).cast("long").alias("salts")).toPandas().sort_values("part")
    held = spark.sparkContext.broadcast((hot["part"].to_numpy(np.int64), hot["salts"].to_numpy(np.int64)))
    index = text.mapInArrow(releasing(lambda b: cut(b, "index")), "part long, line long, sketch long")
    probes = text.mapInArrow(releasing(lambda b: cut(b, "probes")), "part long, line long, sketch long").withColumnsRenamed({"line": "other", "sketch": "seen"})
    near = F.bit_count(F.col("sketch").bitwiseXOR(F.col("seen"))) <= 4 * tau
    # A task's part of the index is far smaller than what probes it, and no key has more than its share: it is held, nothing is sorted.
    pairs = probes.join(index.hint("shuffle_hash"), "part").where((F.col("line") != F.col("other")) & near)
    pairs = pairs.select(F.least("line", "other").alias("a"), F.greatest("line", "other").alias("b")).distinct().checkpoint()
    wanted = pairs.select(F.col("a").alias("line")).unionByName(pairs.select(F.col("b").alias("line"))).distinct()
    if wanted.limit(broadcast_rows + 1).count() <= broadcast_rows:
        wanted = F.broadcast(wanted)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _lines(batches, shortest):
            found = list(dict.fromkeys(k for r in rows for _, k in r))
            yield pa.RecordBatch.from_arrays([pa.array([long_hash(k) for k in found], pa.int64()), pa.array([long_hash(k, 1) for k in found], pa.int64()), pa.array(found, pa.string())], ["line", "check", "text"])

    spelt = text.mapInArrow(releasing(spell), "line long, check long, text string").join(wanted, "line").dropDuplicates(["line", "check"])
    side = lambda x: spelt.select(F.col("line").alias(x), F.col("check").alias(f"check_{x}"), F.col("text").alias(f"text_{x}"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within(a, b, int(edits(min(len(a), len(b)), tau, least))) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], batch.schema.names[:4]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "check_a", "b", "check_b", "text_a", "text_b")
    links = both.mapInArrow(verify, "a long, check_a long, b long, check_b long")
    start = lambda x: first.select(F.col("line").alias(x), F.col("check").alias(f"check_{x}"), F.col("first").alias(f"first_{x}"))
    dated = links.join(start("a"), ["a", "check_a"]).join(start("b"), ["b", "check_b"])
    later = F.col("first_a") > F.col("first_b")
    late = dated.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("line"), F.when(later, F.col("check_a")).otherwise(F.col("check_b")).alias("check")).distinct()
    # Classes of which something goes: later copies, or all, where an earlier line is near.
    going = first.join(late.withColumn("late", F.lit(True)), ["line", "check"], "left").where("c > 1 OR late").select("line", "check", "first", "late")
    total = first.agg(F.sum("c")).first()[0] or 0
    share = max(HOT, total // HOT_KEYS)
    hot = first.where(F.col("c") > share).select("line", "check", F.ceil(F.col("c") / share).cast("int").alias("salts"))
    going = going.join(F.broadcast(hot), ["line", "check"], "left").withColumn("salt", F.explode(_salts())).drop("salts")
    gone = lines.join(F.broadcast(hot), ["line", "check"], "left").withColumn("salt", _salt(F.col("key"))).drop("salts").join(going, ["line", "check", "salt"])
    begins = (F.col("key") == F.col("first.key")) & (F.col("number") == F.col("first.number"))
    gone = gone.where(F.col("late") | ~begins).groupBy("key").agg(F.collect_list(F.struct("number", begins.alias("near"))).alias("gone"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in small(b)):
            out = []
            for t, removed in zip(texts_of(batch), batch.column(batch.schema.get_field_index("gone")).to_pylist()):
                rows = (t or "").split("\n")
                drop = {x["number"] for x in removed or ()}
                kept = "\n".join([x for i, x in enumerate(rows) if i not in drop]) if drop else t or ""
                out.append((len(rows), sum(key_of(x) != "" for x in rows), len(drop), sum(x["near"] for x in removed or ()), hashlib.sha256(kept.encode()).hexdigest(), kept if with_text else None))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            taken = [batch.column(0), *(batch.column(batch.schema.get_field_index(x)) for x in borne)]
            yield pa.RecordBatch.from_arrays([*taken, *columns], ["id", *borne, "n_lines", "n_judged", "n_removed", "n_near", "kept_sha256", "kept_text"])

    borne = [f"carried{i}" for i in range(len(carry))]
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(x) for c, x in zip(carry, borne)))
    kinds = "".join(f"{x} {docs.schema[c].dataType.simpleString()}, " for c, x in zip(carry, borne))
    out = rows.join(gone, "key", "left").select("id", "text", "gone", *borne).mapInArrow(releasing(keep), f"id {kind}, {kinds}n_lines long, n_judged long, n_removed long, n_near long, kept_sha256 string, kept_text string")
    out = out.withColumnsRenamed({"id": id_col} | dict(zip(borne, carry)))
    return out if with_text else out.drop("kept_text")
