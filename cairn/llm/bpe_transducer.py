"""Byte-pair tokenization as two deterministic transducers.

The first one reads characters and marks where the pattern that precedes the merges begins a piece. It has eleven
states, so a chunk of text is a map from entry state to exit state; the maps of all chunks compose by a prefix scan,
which gives every chunk its entry state, and then all chunks emit their marks at once.

The second one reads the bytes of a piece. Its states are prefixes of pieces; each transition is annotated with the
change in the number of tokens that the byte brings, so a piece's token count is the sum over its path. Paths are
determinized when a piece is first met; their sums are kept in a table of bounded size that is emptied when full, which
changes speed, never results. The states follow from a property of merges: a sequence of tokens is the tokenization of its bytes if
and only if that holds for each two neighbours, so the last token of a prefix is the one suffix token that can stand
beside the last token of the rest.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import regex
import tiktoken
from tokenizers.pre_tokenizers import ByteLevel

# Classes of characters, and states after a character, of the piece transducer.
LETTER, STMD, RV, L, E, NUMBER, QUOTE, OTHER, SPACE, WHITE, END = range(11)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_QUOTE, QUOTE_RV, QUOTE_L, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE = range(11)
#: Marks: a piece begins at this character, at the one before.
HERE, BEFORE = 1, 2
SEPARATOR = "\ud800"  # no text that Spark holds has a lone surrogate
CHUNK = 128
# The code points that the pattern calls white space.
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _moves(state: int, kind: int) -> tuple[int, int]:
    """The next state and the marks when a character of some class is read."""
    letter = kind in (LETTER, STMD, RV, L, E)
    if state in (QUOTE_RV, QUOTE_L):
        if kind == (E if state == QUOTE_RV else L):
            return START, 0
        to, marks = _moves(IN_LETTERS, kind)
        return to, marks | BEFORE
    if kind == END:
        return START, HERE
    white = {SPACE: MORE_SPACE, WHITE: MORE_WHITE}
    if state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE) and kind in white:
        return white[kind], 0
    if state in (ONE_SPACE, MORE_SPACE):  # the last space belongs to what follows
        return (IN_LETTERS if letter else IN_NUMBERS if kind == NUMBER else IN_OTHERS), BEFORE * (state == MORE_SPACE)
    if state == AFTER_QUOTE:
        if kind == STMD:
            return START, 0
        if kind in (RV, L):
            return (QUOTE_RV if kind == RV else QUOTE_L), 0
    last = BEFORE * (state == MORE_WHITE)
    if letter:
        return IN_LETTERS, last | HERE * (state != IN_LETTERS)
    if kind == NUMBER:
        return IN_NUMBERS, last | HERE * (state != IN_NUMBERS)
    if kind in (QUOTE, OTHER):
        if state in (IN_OTHERS, AFTER_QUOTE):
            return IN_OTHERS, 0
        return (AFTER_QUOTE if kind == QUOTE else IN_OTHERS), last | HERE
    return (ONE_SPACE if kind == SPACE else ONE_WHITE), HERE


def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "\x00" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    # Releases of Unicode differ; where this one is newer than the interpreter's, the tokenizer's library decides.
    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero(table != OTHER).tolist():
        if unicodedata.category(every[c]) == "Cn":
            table[c] = LETTER if len(cut("a" + every[c])) == 1 else NUMBER if len(cut("1" + every[c])) == 1 else OTHER
    table[list(WHITE_SPACE)] = WHITE
    for chars, kind in (("stmd", STMD), ("rv", RV), ("l", L), ("e", E), ("'", QUOTE), (" ", SPACE), (SEPARATOR, END)):
        for c in chars:
            table[ord(c)] = kind
    return table


class PieceTransducer:
    def __init__(self) -> None:
        self.classes = _class_table()
        self.to, self.marks = np.zeros(256, np.uint8), np.zeros(256, np.uint8)  # by class * 16 + state
        for kind in range(11):
            for state in range(11):
                self.to[kind * 16 + state], self.marks[kind * 16 + state] = _moves(state, kind)

    def starts(self, joined: str) -> np.ndarray:
        """Where pieces begin in texts that are joined by, and end with, SEPARATOR, which counts as a piece."""
        kinds = self.classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        n, rows = len(kinds), -(-len(kinds) // CHUNK)
        padded = np.full(rows * CHUNK, END, np.uint8)
        padded[:n] = kinds
        steps = np.ascontiguousarray(padded.reshape(rows, CHUNK).T) << 4
        maps = np.repeat(np.arange(11, dtype=np.uint8)[:, None], rows, axis=1)
        for kind in steps:
            maps = self.to[maps | kind]
        maps, gap = np.ascontiguousarray(maps.T), 1
        while gap < rows:  # after the scan, a chunk's map goes from the state before the first chunk
            maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].copy(), axis=1)
            gap *= 2
        state = np.concatenate((np.zeros(1, np.uint8), maps[:-1, START]))
        marks = np.empty_like(steps)
        for i, kind in enumerate(steps):
            at = state | kind
            marks[i] = self.marks[at]
            state = self.to[at]
        flat = marks.T.ravel()[:n]
        begins = (flat & HERE).astype(bool)
        begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
        return np.flatnonzero(begins)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that vocabulary files of this kind use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTransducer:
    """Token counts and ids of pieces, from the vocabulary and the ordered merges of a byte-level file."""

    def __init__(self, blob: bytes, most_pairs: int = 300_000) -> None:
        file = json.loads(blob)
        letters = _byte_letters()
        raw = {k: bytes(letters[c] for c in k) for k in file["model"]["vocab"] if all(c in letters for c in k)}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        ids = {raw[k]: v for k, v in file["model"]["vocab"].items() if k in raw and k not in self.special}
        #: Tokens are numbered by the order of their merges, single bytes first.
        self.single = [bytes([b]) for b in range(256)]
        self.bytes_of, self.parts, self.pair = list(self.single), [(-1, -1)] * 256, {}
        number = {x: i for i, x in enumerate(self.single)}
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]):
            u, v = number[raw[a]], number[raw[b]]
            new = len(self.bytes_of)
            self.bytes_of.append(raw[a] + raw[b])
            self.parts.append((u, v))
            self.pair[u, v] = new
            number[raw[a] + raw[b]] = new
        self.id_of = np.array([ids.get(x, 0) for x in self.bytes_of], np.uint32)
        self.fits: dict[tuple[int, int], bool] = {}
        stands = [True] * 256  # whether a token's own bytes are merged to it
        for u, v in self.parts[256:]:
            stands.append(stands[u] and stands[v] and self._border_holds(u, v))
        self.token = {x: n for x, n in number.items() if stands[n]}
        # A tree of the tokens read from their ends: what a prefix ends with is found in as many steps as it has bytes.
        self.back, self.ends = {}, [-1]
        for x, n in self.token.items():
            node = 0
            for b in reversed(x):
                to = self.back.get(node << 8 | b)
                if to is None:
                    to = self.back[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                node = to
            self.ends[node] = n
        self.longest = max(map(len, self.token))
        self.most = most_pairs

    def _border_holds(self, u: int, v: int) -> bool:
        """Whether no merge bridges the border between u and v while their bytes are merged to u and v."""
        while max(u, v) >= 256:
            # Back in time: what was made last is taken apart. At equal rank the left of two candidates goes first.
            if u > v:
                made, u = u, self.parts[u][1]
                bridged = self.pair.get((u, v), made) < made
            else:
                made, v = v, self.parts[v][0]
                bridged = self.pair.get((u, v), made + 1) <= made
            if bridged:
                return False
        return True

    def beside(self, u: int, v: int) -> bool:
        """Whether tokens u, v are what their joint bytes are split into."""
        known = self.fits.get((u, v))
        if known is None:
            if len(self.fits) >= self.most:
                self.fits.clear()
            known = self.fits[u, v] = (u, v) not in self.pair and self._border_holds(u, v)
        return known

    def _path(self, piece: bytes) -> tuple[list[int], list[int]]:
        """The state after every prefix of a piece: its last token, and its token count, the sum of the emissions."""
        get, known, back, ends, n = self.token.get, self.fits.get, self.back.get, self.ends, len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            t = get(piece[:end]) if end <= self.longest else None
            if t is not None:
                last[end], count[end] = t, 1
                continue
            node, begin = 0, end
            while begin > 1:
                begin -= 1
                node = back(node << 8 | piece[begin])
                if node is None:
                    break
                t = ends[node]
                if t >= 0:
                    fits = known((last[begin], t))
                    if fits is None:
                        fits = self.beside(last[begin], t)
                    if fits:
                        last[end], count[end] = t, count[begin] + 1
                        break
        return last, count

    def count(self, piece: bytes) -> int:
        return self._path(piece)[1][-1]

    def ids(self, piece: bytes) -> list[int]:
        last, _ = self._path(piece)
        out, end = [], len(piece)
        while end:
            out.append(int(self.id_of[last[end]]))
            end -= len(self.bytes_of[last[end]])
        return out[::-1]


class _Pieces(dict):
    """What a piece contributes, worked out when it is first met; emptied when it holds too many."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece: str):
        if len(self) >= self.most:
            self.clear()
        out = self[piece] = self.make(piece)
        return out


class Tokenizer:
    """Counts or ids for lists of texts. Special strings inside texts are tokens, as is the library's default."""

    def __init__(self, blob: bytes, most_pieces: int = 200_000) -> None:
        self.cut = PieceTransducer()
        self.merge = MergeTransducer(blob)
        self.counts = _Pieces(lambda p: 0 if p == SEPARATOR else self.merge.count(p.encode()), most_pieces)
        self.packed = _Pieces(self._pack, most_pieces)
        self.codec, self.words_of = None, []
        names = sorted(self.merge.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def forget(self) -> None:
        """Empties what is kept of pieces; what is compiled stays."""
        self.counts.clear(), self.packed.clear(), self.merge.fits.clear()

    def _pack(self, piece: str) -> bytes:
        """The ids of one piece; a compiled library merges its bytes, by the same vocabulary."""
        if piece == SEPARATOR:
            return b""
        if self.codec is None:
            ranks = {x: i for i, x in enumerate(self.merge.bytes_of)}
            self.codec = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            self.words_of = [int(i).to_bytes(4, "little") for i in self.merge.id_of]
        return b"".join([self.words_of[r] for r in self.codec._encode_single_piece(piece)])

    def _parts(self, texts: list[str]) -> tuple[str, list[int], list[str]]:
        """The texts without special strings, joined; the text of each part; the special string after it."""
        parts, owner, after = [], [], []
        for i, t in enumerate(texts):
            found = self.split.split(t) if self.split and any(s in t for s in self.merge.special) else [t]
            parts += found[0::2]
            owner += [i] * len(found[0::2])
            after += found[1::2] + [""]
        return SEPARATOR.join(parts) + SEPARATOR, owner, after

    def _pieces(self, joined: str) -> tuple[list[str], np.ndarray]:
        """All pieces, and where the separators stand among them."""
        starts = self.cut.starts(joined)
        bounds = starts.tolist() + [len(joined)]
        pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        ends = np.flatnonzero(np.diff(np.append(starts, len(joined))) == 1)
        return pieces, np.array([i for i in ends.tolist() if pieces[i] == SEPARATOR], np.int64)

    def count_texts(self, texts: list[str]) -> np.ndarray:
        joined, owner, after = self._parts(texts)
        pieces, ends = self._pieces(joined)
        total = np.cumsum(np.fromiter(map(self.counts.__getitem__, pieces), np.int64, len(pieces)))
        out = np.zeros(len(texts), np.int64)
        np.add.at(out, owner, np.diff(total[ends], prepend=0) + np.array([bool(x) for x in after], np.int64))
        return out

    def id_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        joined, owner, after = self._parts(texts)
        pieces, ends = self._pieces(joined)
        packed = list(map(self.packed.__getitem__, pieces))
        out, begin = [b""] * len(texts), 0
        for i, end, special in zip(owner, ends.tolist(), after):
            ids = b"".join(packed[begin:end])
            if special:
                ids += np.array([self.merge.special[special]], "<u4").tobytes()
            out[i] = out[i] + ids if out[i] else ids
            begin = end + 1
        return out
