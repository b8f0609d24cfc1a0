"""Cutting texts into words before the merges, vectorised over the UTF-8 buffer of an Arrow column.

Equals the public pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+.
Code points get a class (space, letter, number, other); a word starts where the class changes, at the last space of a
run before a word, and after a contraction. The words are offsets into the texts' own buffer: nothing is copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Bytes of text worked on at once; a single text beyond that is worked on alone.
PIECE_BYTES = 2 << 20


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            # the string leaves the surrogates out, so that a run may span them
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, code points) of well-formed UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    cp = lead.astype(np.int32)
    for least, most, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        rows = np.flatnonzero((lead >= least) & (lead < most))
        if len(rows):
            v = cp[rows] & mask
            for k in range(1, more + 1):
                v = (v << 6) | (data[at[rows] + k] & 0x3F)
            cp[rows] = v
    return at, cp


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about so many bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, upto
        at = upto


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, number of words of each text). texts: strings without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]]
    at, cp = code_points(data)
    kind = classes()[cp]
    n = len(cp)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets[:-1] - offsets[0])] = True  # an empty text marks the start of the next
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # a space before a word belongs to it; other white space before a word is a word of its own
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
    start[after - 1] = True
    start[after[cp[after - 1] == 0x20]] = False
    quote = np.flatnonzero((cp == 0x27) & start[:n])
    if len(quote):
        ends = np.flatnonzero(first)
        left = ends[np.searchsorted(ends, quote, side="right")] - quote  # code points up to the text's end
        c1 = cp[np.minimum(quote + 1, n - 1)]
        c2 = cp[np.minimum(quote + 2, n - 1)]
        two = (left >= 2) & np.isin(c1, [ord(c) for c in "stmd"])
        three = (left >= 3) & (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l")))
        start[quote[two | three] + 1] = False
        start[quote[two] + 2] = True
        start[quote[three] + 3] = True
    begins = np.flatnonzero(start[:n])
    cuts = np.empty(len(begins) + 1, np.int32)
    cuts[:-1], cuts[-1] = at[begins] + offsets[0], offsets[-1]
    out = pa.StringArray.from_buffers(len(begins), pa.py_buffer(cuts), buffer)
    where = np.searchsorted(cuts[:-1], offsets)
    return out, np.diff(where).astype(np.int64)
