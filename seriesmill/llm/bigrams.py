"""Character bigrams of a corpus: counted vectorised, scored by table."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa

from seriesmill.llm.pretokens import code_points

#: All characters of East Asian scripts share this symbol in the bigrams; each has its own frequency within it.
EAST = 0x6587
BLANK, DIGIT = 0x20, 0x30


def is_east(cp: np.ndarray) -> np.ndarray:
    return ((cp >= 0x2E80) & (cp < 0xD800)) | ((cp >= 0xF900) & (cp < 0xFB00)) | ((cp >= 0xFE30) & (cp < 0xFE50)) | ((cp >= 0xFF00) & (cp < 0xFFF0)) | ((cp >= 0x20000) & (cp < 0x40000))


def symbols(cp: np.ndarray) -> np.ndarray:
    """Digits as one, white space as one, East Asian characters as one; the others as themselves."""
    out = cp.copy()
    out[(cp >= 0x30) & (cp <= 0x39)] = DIGIT
    out[(cp >= 9) & (cp <= 13)] = BLANK
    out[is_east(cp)] = EAST
    return out


@lru_cache(maxsize=1 << 16)
def symbol(c: str) -> int:
    return int(symbols(np.array([ord(c)], np.int32))[0])


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each followed by one blank; places where the texts begin, and the end)"""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[0] < offsets[-1] else np.zeros(0, np.uint8)
    at, cp = code_points(data) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    places = np.searchsorted(at, offsets - offsets[0])
    begin = places + np.arange(len(places))
    out = np.full(len(cp) + len(texts), BLANK, np.int32)
    out[np.arange(len(cp)) + np.searchsorted(places[1:], np.arange(len(cp)), side="right")] = cp
    return out, begin


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, places where they begin, and the end)"""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[0] < offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def wide_words(texts: pa.Array) -> pa.Array:
    """Of each text the words (between white space) with a character above ASCII, with a blank after each. Most texts have few."""
    data, begin = _bytes(texts)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[begin] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    wide = np.concatenate(([0], np.cumsum(data >= 0x80, dtype=np.int64)))
    hit = wide[last] > wide[first]
    first, last = first[hit], last[hit]
    size = last - first + 1
    out = np.full(int(size.sum()), BLANK, np.uint8)
    at = np.cumsum(size) - size
    own = size - 1
    within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    out[within + np.repeat(at, own)] = data[within + np.repeat(first, own)]
    doc = np.searchsorted(begin, first, side="right") - 1
    ends = np.concatenate(([0], np.cumsum(np.bincount(doc, size, len(texts)).astype(np.int64))))
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out))


def counts(texts: pa.Array, words: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, n): (a << 21) + b for each bigram that isn't wholly ASCII, a for each symbol, -cp for East Asian characters.

    words: wide_words of the texts, where they are known.
    """
    data, _ = _bytes(texts)
    every = np.bincount(data, minlength=256)
    plain = every[:0x80].copy()
    plain[DIGIT] = plain[0x30:0x3A].sum()
    plain[0x31:0x3A] = 0
    plain[BLANK] += plain[9:14].sum() + len(texts)
    plain[9:14] = 0
    cp, _ = laid_out(wide_words(texts) if words is None else words)
    s = symbols(cp).astype(np.int64)
    wide = s >= 0x80
    both = wide[1:] | wide[:-1]
    k, n = np.unique(np.concatenate([(s[:-1][both] << 21) + s[1:][both], s[wide], -cp[is_east(cp)].astype(np.int64)]), return_counts=True)
    held = np.flatnonzero(plain)
    return np.concatenate([k, held]), np.concatenate([n, plain[held]])


#: Up to so many symbols a table of all their pairs is made: 32 MB.
MOST_SYMBOLS = 2000


class Bigrams:
    """log P(b | a), smoothed towards P(b)."""

    #: Weight of P(b) in observations, and the least P(b).
    WEIGHT, LEAST = 5.0, 1e-9

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        one = (keys >= 0) & (keys < 1 << 21)
        self.single = dict(zip(keys[one].tolist(), n[one].tolist(), strict=True))
        self.total = max(1, sum(self.single.values()))
        pair = keys >= 1 << 21
        order = np.argsort(keys[pair])
        self.keys, self.n = keys[pair][order], n[pair][order].astype(np.float64)
        east = keys < 0
        self.east = dict(zip((-keys[east]).tolist(), n[east].tolist(), strict=True))
        self.easts = max(1, sum(self.east.values()))
        #: ASCII, and all characters above it that the corpus holds.
        self.known = frozenset(map(chr, range(0x80))) | {chr(k) for k in (*self.single, *self.east) if 0x80 <= k < 0x110000}
        self.east_log = np.full(0x110000, math.log(1e-7))
        self.east_log[-keys[east]] = np.log(np.maximum(n[east] / self.easts, 1e-7))
        # symbols by number; 0 stands for those that the corpus lacks
        held = np.unique(np.concatenate((np.arange(0x80), keys[one])))
        self.number = np.zeros(0x110000, np.int32)
        self.number[held] = np.arange(1, len(held) + 1)
        self.number[0x30:0x3A], self.number[9:14] = self.number[DIGIT], self.number[BLANK]
        every = np.arange(0x110000)
        self.number[is_east(every)] = self.number[EAST]
        count = np.zeros(len(held) + 1)
        count[self.number[keys[one]]] = n[one]
        self.count, self.part = count, np.maximum(count / self.total, self.LEAST)
        self.ascii = np.concatenate(([False], held < 0x80))
        self.table = self._table() if len(held) < MOST_SYMBOLS else None
        self.seen: dict[int, float] = {}
        self.pairs = dict(zip(self.keys.tolist(), self.n.tolist(), strict=True))

    def log_p(self, a: int, b: int) -> float:
        """Of symbols. Bigrams of ASCII aren't counted; they stand on both sides of a comparison, at a usual value."""
        if a < 0x80 and b < 0x80:
            return -3.0
        key = (a << 21) + b
        out = self.seen.get(key)
        if out is None:
            p = max(self.single.get(b, 0) / self.total, self.LEAST)
            out = self.seen[key] = math.log((self.pairs.get(key, 0.0) + self.WEIGHT * p) / (self.single.get(a, 0) + self.WEIGHT))
        return out

    def seen_beside(self, left: int, first: str, last: str, right: int) -> bool:
        """Whether the corpus has the first character after left, or the last before right. Both are above ASCII."""
        return (left << 21) + symbol(first) in self.pairs or (symbol(last) << 21) + right in self.pairs

    def _table(self) -> np.ndarray:
        """log_p of all pairs of numbers."""
        out = np.log(self.WEIGHT * self.part[None] / (self.count + self.WEIGHT)[:, None])
        a, b = self.number[self.keys >> 21], self.number[self.keys & 0x1FFFFF]
        out[a, b] = np.log((self.n + self.WEIGHT * self.part[b]) / (self.count[a] + self.WEIGHT))
        out[np.ix_(self.ascii, self.ascii)] = -3.0
        return out.reshape(-1)

    def log_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log_p of many bigrams, given by their numbers: from a table of all, or one by one where there are too many symbols for it."""
        if self.table is not None:
            return self.table[a.astype(np.int64) * len(self.count) + b]
        symbol_of = np.zeros(len(self.count), np.int64)
        seen = np.flatnonzero(self.number)[::-1]
        symbol_of[self.number[seen]] = symbols(seen.astype(np.int32))
        key = (symbol_of[a] << 21) + symbol_of[b]
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        n = np.where((self.keys[at] == key) & (a > 0) & (b > 0), self.n[at], 0.0) if len(self.keys) else np.zeros(len(key))
        return np.where(self.ascii[a] & self.ascii[b], -3.0, np.log((n + self.WEIGHT * self.part[b]) / (self.count[a] + self.WEIGHT)))

    def scores(self, left: np.ndarray, texts: list[str], right: np.ndarray) -> np.ndarray:
        """log P of each text between its neighbours (symbols)."""
        if not texts:
            return np.zeros(0)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(size + 2)
        begin = ends - size - 2
        s = np.zeros(ends[-1], np.int32)
        inner = np.ones(len(s), bool)
        inner[begin] = inner[ends - 1] = False
        s[inner] = self.number[cp]
        s[begin], s[ends - 1] = self.number[left], self.number[right]
        # the pair of a text's right neighbour with the next text's left one counts for nothing
        lp = np.zeros(len(s))
        lp[:-1] = self.log_pairs(s[:-1], s[1:])
        lp[ends - 1] = 0
        out = np.add.reduceat(lp, begin)
        wide = np.flatnonzero(cp >= 0x2E80)
        east = wide[is_east(cp[wide].astype(np.int32))]
        if not len(east):
            return out
        row = np.searchsorted(np.cumsum(size), east, side="right")
        return out + np.bincount(row, self.east_log[cp[east]], len(texts))

    def score(self, left: int, text: str, right: int) -> float:
        return float(self.scores(np.array([left]), [text], np.array([right]))[0])
