"""Letters behind a swap that no list has (problem 10): what a character stands for, told from its neighbours alone.

A code page nobody listed is a substitution cipher too. In a source that was read by it, a character turns up, within one
language, that other sources hardly have, and its neighbours are those of a letter. For each source and language each such
character is compared with each letter of the language: how likely are its neighbours beside the letter, by the bigrams that
the other sources have of the language? Expectation-maximization: the letters found so far (E) replace the characters among
the neighbours (M), since a garbled letter often stands beside another one, and the characters are looked at again.

Accepted is a letter whose neighbours these usually are, which no other letter fits as well, at least PAGE of them for a
source and language (a page swaps more than one letter), each letter for one character only. Texts without a language, and
languages of one source only, have nothing to compare with and give no letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import bigrams
from seriesmill.llm.shared import Lookup, share
from seriesmill.session import checkpoint

#: Distinct tokens that must hold a character before its letter is told, and how much rarer it is elsewhere.
LEAST_TOKENS, RARER = 8, 0.1
#: Letters that a source and language needs.
PAGE = 2
ROUNDS = 4
#: How much less likely (in log, per neighbourhood) than a letter's own neighbours those of a character may be, and by how much
#: (in log, of all of them together) the best letter must be ahead.
WORSE, AHEAD = 1.5, 4.6
SMOOTH = 0.5


def neighbourhoods(kinds: DataFrame) -> DataFrame:
    """src, lang, l, u, r, n: how often the tokens (distinct within a source and language) have a character above ASCII between two symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cp, begin = bigrams.laid_out(b.column("token").cast(pa.string()))
            s = bigrams.symbols(cp).astype(np.int64)
            row = np.searchsorted(begin, np.arange(len(s)), side="right") - 1
            at = np.flatnonzero((s >= 0x80) & (s != bigrams.EAST))
            own = row[at]
            left, right = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[own] for c in ("left", "right"))
            left = np.where(at > begin[own], s[np.maximum(at - 1, 0)], left)
            right = np.where(at < begin[own + 1] - 2, s[np.minimum(at + 1, len(s) - 1)], right)
            src, lang = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[own] for c in ("src", "lang"))
            key, n = np.unique(np.stack([src, lang, left, s[at], right]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in key), pa.array(n.astype(np.int64))], names=["src", "lang", "l", "u", "r", "n"])

    rows = kinds.select("src", "lang", "left", "token", "right").where("lang <> 0")
    schema = "src bigint, lang bigint, l bigint, u bigint, r bigint, n bigint"
    return rows.mapInArrow(run, schema).groupBy("src", "lang", "l", "u", "r").agg(F.sum("n").alias("n"))


def _pairs(l: np.ndarray, u: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of bigrams, which neighbourhood each is of): both beside u, those of two such characters once."""
    last = (r < 0x80) | (r == bigrams.EAST)
    return np.concatenate(((l << 21) + u, (u[last] << 21) + r[last])), np.concatenate((np.arange(len(u)), np.flatnonzero(last)))


def language_bigrams(around: DataFrame) -> DataFrame:
    """lang, key, n of all sources; a character by itself has its code point as key."""
    last = (F.col("r") < 0x80) | (F.col("r") == bigrams.EAST)
    key = lambda a, b: F.shiftleft(F.col(a), 21) + F.col(b)
    keys = F.array(key("l", "u"), F.when(last, key("u", "r")), F.col("u"))
    each = around.select("lang", F.explode(keys).alias("key"), "n").where("key IS NOT NULL")
    return each.groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Others:
    """Bigrams of a language, without those of one source."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, l: np.ndarray, u: np.ndarray, r: np.ndarray, own: np.ndarray) -> None:
        pair, of = _pairs(l, u, r)
        every = np.concatenate((keys, pair, u))
        self.keys, at = np.unique(every, return_inverse=True)
        weight = np.concatenate((n.astype(float), -own[of].astype(float), -own.astype(float)))
        self.n = np.maximum(np.bincount(at, weight, len(self.keys)), 0)
        one = (self.keys < 1 << 21) & (self.n > 0)
        self.single, self.single_n = self.keys[one], self.n[one]
        self.total = max(1.0, float(self.single_n.sum()))

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == keys, self.n[at], 0.0) if len(self.keys) else np.zeros(keys.shape)

    def fit(self, l: np.ndarray, v: np.ndarray, r: np.ndarray) -> np.ndarray:
        """log of how usual v is between l and r, up to what doesn't depend on v."""
        n = self.of(v)
        return np.log(self.of((l << 21) + v) + SMOOTH * n / self.total) + np.log((self.of((v << 21) + r) + SMOOTH / 50) / (n + SMOOTH))

    def usual(self, v: int) -> float:
        """Mean of fit() over v's own neighbours."""
        pair = (self.keys >= 1 << 21) & (self.n > 0)
        keys, n = self.keys[pair], self.n[pair]
        before, after = (keys & 0x1FFFFF) == v, (keys >> 21) == v
        m = float(self.of(np.array([v]))[0])
        left = np.average(np.log(n[before] + SMOOTH * m / self.total), weights=n[before]) if before.any() else 0.0
        right = np.average(np.log((n[after] + SMOOTH / 50) / (m + SMOOTH)), weights=n[after]) if after.any() else 0.0
        return float(left + right)


def letters_of(l: np.ndarray, u: np.ndarray, r: np.ndarray, n: np.ndarray, others: Others) -> dict[int, tuple[int, float]]:
    """The letter that each character of a source and language stands for, where that can be told, and (in log) how much rarer the
    character is elsewhere than in all."""
    chars, of = np.unique(u, return_inverse=True)
    own = np.bincount(of, n)
    rare = others.of(chars) / others.total < RARER * own / own.sum()
    chars = chars[(own >= LEAST_TOKENS) & rare]
    letters = np.array([v for v in others.single[others.single_n >= LEAST_TOKENS].tolist() if chr(v).isalpha()], np.int64)
    if len(chars) < PAGE or not len(letters):
        return {}
    usual = {int(v): others.usual(int(v)) for v in letters}
    now: dict[int, int] = {}
    for _ in range(ROUNDS):
        stands = lambda x: np.array([now.get(c, c) for c in x.tolist()], np.int64)  # noqa: E731, B023
        left, right = stands(l), stands(r)
        found: list[tuple[float, int, int]] = []
        for c in chars.tolist():
            at = np.flatnonzero(u == c)
            fit = others.fit(left[at][:, None], letters[None], right[at][:, None])
            mean = np.average(fit, weights=n[at], axis=0)
            mean[letters == c] = -np.inf
            best = int(mean.argmax())
            second = float(np.partition(mean, -2)[-2]) if len(mean) > 1 else -np.inf
            if mean[best] >= usual[int(letters[best])] - WORSE and (mean[best] - second) * n[at].sum() >= AHEAD:
                found.append((float(mean[best] - usual[int(letters[best])]), c, int(letters[best])))
        after: dict[int, int] = {}
        for _, c, v in sorted(found, reverse=True):
            if v not in after.values():
                after[c] = v
        if after == now:
            break
        now = after
    if len(now) < PAGE:
        return {}
    count = dict(zip(np.unique(u).tolist(), own.tolist(), strict=True))
    out = {c: float(others.of(np.array([c]))[0]) for c in now}
    every = own.sum() + others.total
    return {c: (v, float(np.log((count[c] + out[c]) / every / ((out[c] + SMOOTH) / others.total)))) for c, v in now.items()}


def learn_letters(kinds: DataFrame) -> DataFrame:
    """src, mark, letter, rarer: what characters stand for in the tokens of a source (src, lang, left, token, right; lang 0: not
    known), and how much rarer each is elsewhere."""
    around = checkpoint(neighbourhoods(kinds))
    lookup: Lookup = share(language_bigrams(around), "lang", ("key", "n"))

    def run(t: pa.Table) -> pa.Table:
        l, u, r, n = (t[c].to_numpy() for c in ("l", "u", "r", "n"))
        keys, m = lookup[t["lang"][0].as_py()]
        got = letters_of(l, u, r, n, Others(keys, m, l, u, r, n))
        return pa.table({
            "src": pa.array([t["src"][0].as_py()] * len(got), pa.int64()), "mark": pa.array([chr(c) for c in got], pa.string()),
            "letter": pa.array([chr(v) for v, _ in got.values()], pa.string()), "rarer": pa.array([x for _, x in got.values()], pa.float64()),
            "n": pa.array([int(n[u == c].sum()) for c in got], pa.int64()),
        })

    told = around.groupBy("src", "lang").applyInArrow(run, "src bigint, mark string, letter string, rarer double, n bigint")
    # a character that stands for two letters in two languages is taken for the more frequent one
    best = told.groupBy("src", "mark").agg(F.max(F.struct("n", "letter", "rarer")).alias("b"))
    return best.select("src", "mark", "b.letter", "b.rarer")
