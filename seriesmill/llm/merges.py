"""Byte-pair merges over a set of distinct words: merge replay with an inverted index from token pair to positions."""

from __future__ import annotations

import heapq
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

TOKENIZERS = "/opt/tokenizers"


class Merges:
    """The merges of a byte-level vocabulary in rank order."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = [ids[a + b] for a, b in pairs]
        self.rank = {(a << 20) | b: r for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))}
        keys = (self.left << 20) | self.right
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order
        self.byte_id = np.array([ids[c] for c in byte_letters()], np.int64)

    def ranks_of(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair doesn't merge."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_rank[at], -1)


def byte_letters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself where visible, else one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in visible else next(others)) for b in range(256)]


@lru_cache(maxsize=4)
def load(name: str, folder: str = TOKENIZERS) -> Merges:
    return Merges(os.path.join(folder, f"{name}.json"))


def replay(words: pa.Array, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the token ids of each word, words[i] at ids[offsets[i]:offsets[i + 1]].

    All words stand in one sequence of symbols. The index holds, for each pair that merges, the positions where it
    stands; a heap gives the pairs by rank. Applying a merge visits its positions only, and enters the pairs that the
    new symbol forms with its two neighbours, which have higher ranks.
    """
    n = len(words)
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    if not n or bounds[0] == bounds[-1]:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    first = merges.byte_id[data]
    total = len(first)
    last = np.zeros(total, bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    pair = merges.ranks_of((first[:-1] << 20) | first[1:]) if total > 1 else np.zeros(0, np.int64)
    at = np.flatnonzero((pair >= 0) & ~last[:-1]) if total > 1 else np.zeros(0, np.int64)
    order = at[np.argsort(pair[at], kind="stable")]
    found, begins = np.unique(pair[order], return_index=True)
    index: dict[int, list[int]] = {
        r: p for r, p in zip(found.tolist(), (x.tolist() for x in np.split(order, begins[1:])), strict=False)
    } if len(order) else {}
    symbol = first.tolist()
    following = np.where(last, -1, np.arange(1, total + 1)).tolist()  # -1: the word ends here
    before = np.where(np.concatenate(([True], last[:-1])), -1, np.arange(-1, total - 1)).tolist()
    heap = list(index)
    heapq.heapify(heap)
    rank, left, right, made = merges.rank, merges.left, merges.right, merges.made
    while heap:
        r = heapq.heappop(heap)
        a, b, new = int(left[r]), int(right[r]), made[r]
        for p in sorted(index.pop(r)):
            q = following[p]
            if symbol[p] != a or q < 0 or symbol[q] != b:
                continue
            symbol[p], symbol[q] = new, -1
            follow = following[p] = following[q]
            if follow >= 0:
                before[follow] = p
                if (k := rank.get((new << 20) | symbol[follow])) is not None:
                    if k in index:
                        index[k].append(p)
                    else:
                        index[k] = [p]
                        heapq.heappush(heap, k)
            prior = before[p]
            if prior >= 0 and (k := rank.get((symbol[prior] << 20) | new)) is not None:
                if k in index:
                    index[k].append(prior)
                else:
                    index[k] = [prior]
                    heapq.heappush(heap, k)
    done = np.array(symbol, np.int64)
    alive = done >= 0
    offsets = np.concatenate(([0], np.cumsum(alive)))[bounds]
    return done[alive].astype(np.int32), offsets.astype(np.int64)
