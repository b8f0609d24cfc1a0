"""Garbled text from wrong character encoding (problem 10).

A wrong decoding is a substitution cipher: bytes stand for other letters. Which swap of code pages happened isn't known,
and differs by source. So for each source expectation-maximization learns which letter a garbled character stands for,
against the bigrams of the corpus:

1. Bigrams of characters are counted over all texts, and every distinct token with a character above ASCII (source, language,
   neighbours, token) is a suspect, however usual it is: a frequent garbling makes its own bigrams usual.
2. For each source and language, characters get letters by their neighbours alone, against the language's bigrams of the
   other sources (see letters): that finds swaps by code pages that aren't listed.
3. Each distinct suspect is read back through every listed code-page swap, also repeated ones and swaps of parts, and by its
   source's letters, and each result is scored against the bigrams: gain = log P(read back) - log P(as it stands).
4. E: the posterior of each swap (and of none) for each suspect, from gains and the source's table.
   M: the source's table P(swap | character): of the distinct suspects that hold the character, the share explained by
   the swap. Distinct ones, and one of them left out, so that a name with an unusual letter, however often it occurs,
   isn't its own evidence.
   Sources with few cases lean on the table of all.
5. A document is affected if one of its tokens is more likely garbled than not. Single-byte swaps are undone with
   translate(), UTF-8 and double-byte ones by reading their bytes again.

Defined results: null, empty and blank texts aren't affected. U+FFFD and C1 control characters (but U+0085) come from
wrong decodings only: a token with one is affected even where nothing restores it. Sources with fewer than SUPPORT distinct
suspects use the table of all; a null source is one like others. Not found: text wrongly read into East Asian characters (UTF-8 or EUC-JP read as Shift_JIS or GBK), which are part of no
token.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm import bigrams, codepages
from seriesmill.llm.letters import learn_letters
from seriesmill.llm.pretokens import pieces
from seriesmill.llm.shared import fetched
from seriesmill.session import checkpoint

#: Distinct suspects that a source needs for a table of its own.
SUPPORT = 50
#: Stands for all sources without one, and for all sources together.
SMALL, ALL = -2, -1
ITERATIONS = 4
#: P(swap | character) before the first iteration, the least P that it stands, and the weight of the prior table, in suspects.
START, STANDS, WEIGHT = 0.002, 1e-3, 20.0
#: Candidates of less gain are left out. UTF-8 read wrongly has a form of its own; other swaps rest on the gain alone.
LEAST_GAIN, LEAST_GAIN_UTF8 = 2.5, 0.05
#: In a token of more than four kinds of characters above ASCII, one may have been swapped alone if a bigram of it has log P(b | a) below this.
RARE = -5.0
LOST, LEARNED = "lost", "learned"


def _texts(b: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(b.column("text").cast(pa.string()), "")


def _narrow(df: DataFrame) -> DataFrame:
    """doc_id, src (a hash of the source, 0 for null), lang (two letters as a number, 0 where not known), text."""
    source = F.when(F.col("source").isNull(), F.lit(0)).otherwise(F.abs(F.xxhash64("source") % (1 << 62)) + 1)
    two = F.lower(F.substring(F.trim("lang"), 1, 2)) if "lang" in df.columns else F.lit(None).cast("string")
    code = F.when(two.rlike("^[a-z]{2}$"), F.ascii(two) * 256 + F.ascii(F.substring(two, 2, 1))).otherwise(F.lit(0))
    return df.select("doc_id", source.cast("bigint").alias("src"), code.cast("int").alias("lang"), "text")


def _of_tables(df: DataFrame, supported: DataFrame) -> DataFrame:
    """df with SMALL for a src that has no table of its own."""
    known = supported.select(F.col("src").alias("_own"))
    return df.join(known, F.col("src") == F.col("_own"), "left").withColumn("src", F.coalesce("_own", F.lit(SMALL).cast("bigint"))).drop("_own")


#: Distinct tokens that a task remembers before it sends them.
KINDS = 1 << 18


def _tokens(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(text, left, right, first, last, code points) of each token with a character above ASCII; digits as zeros. left, right: the neighbouring symbols."""
    cp, begin = bigrams.laid_out(texts)
    s = bigrams.symbols(cp)
    inside = (s != bigrams.BLANK) & (s != bigrams.EAST)
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    wide = np.concatenate(([0], np.cumsum(cp >= 0x80)))
    hit = wide[last] > wide[first]
    first, last = first[hit], last[hit]
    left = np.where(first > 0, s[np.maximum(first - 1, 0)], bigrams.BLANK)
    right = np.where(last < len(s), s[np.minimum(last, len(s) - 1)], bigrams.BLANK) if len(s) else last
    doc = np.searchsorted(begin, first, side="right") - 1
    return doc, left, right, first, last, np.where((cp >= 0x30) & (cp <= 0x39), 0x30, cp)


def _cut(cp: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[str]:
    whole = cp.astype("<u4").tobytes().decode("utf-32-le", "replace")
    return [whole[i:j] for i, j in zip(first.tolist(), last.tolist(), strict=True)]


def _hashes(src: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray, last: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """A hash of (source, neighbours, token) for each token of the code points."""
    if not len(first):
        return np.zeros(0, np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    base, back = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    power = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(len(cp), base, np.uint64))))
    undo = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(len(cp), back, np.uint64))))
    sums = np.concatenate(([np.uint64(0)], np.add.accumulate((cp.astype(np.uint64) + np.uint64(1)) * mix * power[:-1])))
    h = (sums[last] - sums[first]) * undo[first]
    for x in (src, left, right):
        h = (h ^ (h >> np.uint64(29)) ^ x.astype(np.uint64)) * mix
    return h ^ (h >> np.uint64(32))


def first_look(df: DataFrame) -> DataFrame:
    """What one pass over the texts tells: rows of key, n (bigrams and symbols, see bigrams.counts), and rows of src, lang, left,
    token, right: every suspect, distinct within a task as far as it remembers."""
    types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32())
    names = ["key", "n", "src", "lang", "left", "token", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[tuple, None] = {}

        def out() -> pa.RecordBatch:
            columns = zip(*kinds, strict=True) if kinds else ((),) * len(types)
            none = pa.nulls(len(kinds), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

        for b in batches:
            texts, src, lang = _texts(b), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("src", "lang"))
            for a, z in pieces(texts):
                words = bigrams.wide_words(texts.slice(a, z - a))
                key, n = bigrams.counts(texts.slice(a, z - a), words)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64)), *(pa.nulls(len(key), t) for t in types)], names=names)
                doc, left, right, first, last, cp = _tokens(words)
                kinds.update(dict.fromkeys(zip(src[a + doc].tolist(), lang[a + doc].tolist(), left.tolist(), _cut(cp, first, last), right.tolist(), strict=True)))
                if len(kinds) >= KINDS:
                    yield out()
                    kinds.clear()
        yield out()

    return _narrow(df).mapInArrow(run, "key bigint, n bigint, src bigint, lang int, left int, token string, right int")


#: Bits of the filter by which tasks skip tokens that aren't garbled.
FILTER = 1 << 26


def suspects(df: DataFrame, tokens: DataFrame, supported: np.ndarray) -> DataFrame:
    """doc_id, src, left, token, right wherever a text may hold one of the tokens: all that do, and the few whose hash is alike.

    supported: the sources with a table of their own, sorted; the others are SMALL.
    """
    kind = df.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("token").cast(pa.string())
            for a, z in pieces(text):
                cp, begin = bigrams.laid_out(text.slice(a, z - a))
                h = _hashes(*(b.column(c).to_numpy(zero_copy_only=False)[a:z] for c in ("src", "left", "right")), begin[:-1], begin[1:] - 1, cp)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h % np.uint64(FILTER)).astype(np.int64))], names=["h"])

    places = fetched(tokens.mapInArrow(hashed, "h bigint").distinct(), "places of the filter", FILTER * 8)["h"].to_numpy()
    bits = np.zeros(FILTER // 8, np.uint8)
    np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    shared = df.sparkSession.sparkContext.broadcast((bits, supported))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, supported = shared.value
        for b in batches:
            texts, src = _texts(b), b.column("src").to_numpy(zero_copy_only=False)
            src = np.where(np.isin(src, supported), src, SMALL)
            for a, z in pieces(texts):
                doc, left, right, first, last, cp = _tokens(bigrams.wide_words(texts.slice(a, z - a)))
                h = (_hashes(src[a + doc], left, right, first, last, cp) % np.uint64(FILTER)).astype(np.int64)
                hit = (bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1
                doc, left, right, first, last = (x[hit] for x in (doc, left, right, first, last))
                # each once for a document
                once = list(dict.fromkeys(zip(doc.tolist(), left.tolist(), _cut(cp, first, last) if len(first) else [], right.tolist(), strict=True)))
                doc, left, tokens, right = zip(*once, strict=True) if once else ((),) * 4
                place = a + np.array(doc, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(place)), pa.array(src[place], pa.int64()), pa.array(left, pa.int32()), pa.array(tokens, pa.string()), pa.array(right, pa.int32())],
                    names=["doc_id", "src", "left", "token", "right"],
                )

    return _narrow(df).drop("lang").mapInArrow(run, f"doc_id {kind}, src bigint, left int, token string, right int")


def _marks(text: str) -> list[str]:
    return [c for c in text if c >= "\x80"]


#: Readings of middles (the part of a token from its first to its last non-ASCII character) that a task remembers.
MIDDLES = 1 << 17
#: Middles whose readings are scored together.
MIDDLES_AT_ONCE = 1 << 10


def _lost(token: str) -> list[dict]:
    if any(c == codepages.LOST or "\x80" <= c < "\xa0" and c != "\x85" for c in token):
        return [{"swap": LOST, "before": token, "gain": 12.0}]
    return []


class Reader:
    """What a token may have been, with gains. Swaps leave ASCII alone, so only a token's middle and its neighbours count."""

    def __init__(self, model: bigrams.Bigrams) -> None:
        self.model = model
        self.seen: dict[tuple[int, str, int], list[tuple[str, str, float]]] = {}

    def _odd(self, left: int, middle: str, right: int) -> str:
        """The characters above ASCII that stand in a rare bigram."""
        s = [left, *map(bigrams.symbol, middle), right]
        rare = [self.model.log_p(a, b) < RARE for a, b in zip(s, s[1:], strict=False)]
        return "".join(dict.fromkeys(c for i, c in enumerate(middle) if c >= "\x80" and (rare[i] or rare[i + 1])))

    def _middles(self, keys: list[tuple[int, str, int]]) -> None:
        """Reads the middles back that aren't remembered; all of them are scored together."""
        known = self.model.known
        which: list[int] = []  # the middle of each reading
        readings: list[tuple[str, str, float, float]] = []  # swap, what it was, least gain, what the number of ways costs
        for k, (left, middle, right) in enumerate(keys):
            # without a usual neighbour on either side it's never likelier than what stands
            beside = lambda first, last, left=left, right=right: self.model.seen_beside(left, first, last, right)
            for before, swap in codepages.earlier(middle, known, beside).items():
                which.append(k)
                readings.append((swap, before, LEAST_GAIN_UTF8 if swap.startswith("utf-8") else LEAST_GAIN, 0.0))
            if len(kinds := {c for c in middle if c >= "\x80"}) > codepages.FEW:
                alone = codepages.alone(middle, self._odd(left, middle, right), known)
                # a letter of a long word can be exchanged in many ways, one of which is often likelier
                ways = math.log(max(1, len(kinds) * len(alone)))
                for before, swap in alone.items():
                    which.append(k)
                    readings.append((swap, before, LEAST_GAIN, ways))
        at = np.array(which, np.int64)
        left, right = (np.array([k[i] for k in keys], np.int64) for i in (0, 2))
        base = self.model.scores(left, [k[1] for k in keys], right)
        gain = self.model.scores(left[at], [r[1] for r in readings], right[at]) - base[at]
        found: list[list[tuple[str, str, float]]] = [[] for _ in keys]
        for k, (swap, before, least, ways), g in zip(which, readings, gain.tolist(), strict=True):
            if least == LEAST_GAIN_UTF8 and not known.issuperset(before):
                g = codepages.form(keys[k][1], swap)  # the corpus has a character only garbled, so its bigrams say nothing
            if g - ways > least:
                found[k].append((swap, before, g - ways))
        if len(self.seen) + len(keys) > MIDDLES:
            self.seen.clear()
        self.seen.update(zip(keys, found, strict=True))

    def read(self, lefts: list[int], tokens: list[str], rights: list[int]) -> list[list[dict]]:
        spans, keys = [], []
        for left, token, right in zip(lefts, tokens, rights, strict=True):
            at = [i for i, c in enumerate(token) if c >= "\x80"]
            if not at:
                spans.append(None)
                continue
            first, last = at[0], at[-1] + 1
            key = (bigrams.symbol(token[first - 1]) if first else left, token[first:last], bigrams.symbol(token[last]) if last < len(token) else right)
            spans.append((first, last, key))
            keys.append(key)
        for a in range(0, len(keys), MIDDLES_AT_ONCE):
            part = keys[a : a + MIDDLES_AT_ONCE]
            self._middles([k for k in dict.fromkeys(part) if k not in self.seen])
        # double-byte readings are of whole tokens
        paired = [(i, before, swap) for i, t in enumerate(tokens) if spans[i] for before, swap in codepages.earlier_paired(t).items()]
        own = sorted({i for i, _, _ in paired})
        all_of = lambda places, texts: self.model.scores(np.array([lefts[i] for i in places], np.int64), texts, np.array([rights[i] for i in places], np.int64)).tolist()
        base = dict(zip(own, all_of(own, [tokens[i] for i in own]), strict=True))
        gains: dict[int, list[dict]] = {}
        for (i, before, swap), score in zip(paired, all_of([i for i, _, _ in paired], [b for _, b, _ in paired]), strict=True):
            if score - base[i] > LEAST_GAIN:
                gains.setdefault(i, []).append({"swap": swap, "before": before, "gain": score - base[i]})
        return [[] if span is None else self._token(token, *span) + gains.get(i, []) + _lost(token) for i, (token, span) in enumerate(zip(tokens, spans, strict=True))]

    def _token(self, token: str, first: int, last: int, key: tuple[int, str, int]) -> list[dict]:
        if key not in self.seen:
            self._middles([key])
        # a lone character may stand in a list of symbols
        return [
            {"swap": swap, "before": token[:first] + middle + token[last:], "gain": gain} for swap, middle, gain in self.seen[key] if swap.startswith("utf-8") or len(token) > 1
        ]

    def __call__(self, left: int, token: str, right: int) -> list[dict]:
        return self.read([left], [token], [right])[0]


_READ = pa.list_(pa.struct([("swap", pa.string()), ("before", pa.string()), ("gain", pa.float64()), ("changed", pa.string())]))


def _changed(marks: str, before: str) -> str:
    """The characters that a reading changes: those of the token that it doesn't hold, or all."""
    return "".join(u for u in marks if u not in before) or marks


def scored(events: DataFrame, lm) -> DataFrame:
    """The distinct suspects with `marks` (their characters above ASCII, each once) and `read`: what they may have been."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(bigrams.Bigrams(*lm.value))
        for b in batches:
            tokens = b.column("token").to_pylist()
            marks = ["".join(dict.fromkeys(_marks(t))) for t in tokens]
            out = reader.read(b.column("left").to_pylist(), tokens, b.column("right").to_pylist())
            for own, read in zip(marks, out, strict=True):
                for r in read:
                    r["changed"] = _changed(own, r["before"])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), pa.array(marks, pa.string()), pa.array(out, _READ)], names=[*b.schema.names, "marks", "read"])

    return events.mapInArrow(run, "id bigint, left int, token string, right int, marks string, read array<struct<swap:string,before:string,gain:double,changed:string>>")


def with_letters(events: DataFrame, letters: dict[int, dict[int, tuple[str, float]]], lm) -> DataFrame:
    """events with a further reading of the tokens that hold a character for which their source has a letter.

    The corpus's bigrams hold the source's own characters as well. So the gain is increased, for each, by how much rarer the
    character is in the other sources than in all.
    """
    shared = events.sparkSession.sparkContext.broadcast(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bigrams.Bigrams(*lm.value)
        tables = {s: {u: v for u, (v, _) in t.items()} for s, t in shared.value.items()}
        for b in batches:
            read = b.column("read").to_pylist()
            left, right = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("left", "right"))
            tokens, marks, src = (b.column(c).to_pylist() for c in ("token", "marks", "src"))
            made = [(i, t, before) for i, (s, t) in enumerate(zip(src, tokens, strict=True)) if s in tables and (before := t.translate(tables[s])) != t]
            at = np.array([i for i, _, _ in made], np.int64)
            gain = model.scores(left[at], [x for _, _, x in made], right[at]) - model.scores(left[at], [t for _, t, _ in made], right[at])
            for (i, t, before), g in zip(made, gain.tolist(), strict=True):
                g += sum(shared.value[src[i]][ord(c)][1] for c in t if ord(c) in shared.value[src[i]])
                if g > LEAST_GAIN and all(r["before"] != before for r in read[i]):
                    read[i].append({"swap": LEARNED, "before": before, "gain": g, "changed": _changed(marks[i], before)})
            yield pa.RecordBatch.from_arrays([pa.array(read, _READ) if c == "read" else b.column(c) for c in b.schema.names], names=b.schema.names)

    return events.mapInArrow(run, events.schema)


#: (source, character) -> {swap: probability}; source ALL stands for all, swap "" for each one not listed.
Table = dict[tuple[int, str], dict[str, float]]


#: The same in logarithms: ({swap: log P}, log P of one not listed, log P that the character stands).
Logs = dict[tuple[int, str], tuple[dict[str, float], float, float]]


def in_logs(table: Table) -> Logs:
    out = {key: ({swap: math.log(x) for swap, x in p.items()}, math.log(p[""]), math.log(max(1 - sum(p.values()), STANDS))) for key, p in table.items()}
    out[ALL, ""] = {}, math.log(START), math.log(max(1 - START, STANDS))
    return out


def posterior(table: Logs, src: int, marks: str, swaps: list[str], gains: list[float], changed: list[str]) -> tuple[float, list[float]]:
    """(P(as it stands), P of each reading) of a token with these characters above ASCII."""
    of = {u: table.get((src, u)) or table.get((ALL, u)) or table[ALL, ""] for u in marks}
    logs = []
    for swap, gain, own in zip(swaps, gains, changed, strict=True):
        if swap != LOST:
            gain += sum([of[u][0].get(swap, of[u][1]) for u in own]) / len(own)
        logs.append(gain)
    stands = sum([x[2] for x in of.values()]) / max(1, len(of))
    top = max([stands, *logs])
    weights = [math.exp(x - top) for x in logs]
    rest = math.exp(stands - top)
    total = rest + sum(weights)
    return rest / total, [w / total for w in weights]


def _readings(b: pa.RecordBatch) -> Iterator[tuple[list[str], list[float], list[str]]]:
    """swaps, gains and changed characters of each row's readings."""
    read = b.column("read")
    ends = read.offsets.to_numpy()
    flat = read.flatten()
    swap, gain, changed = (flat.field(c).to_pylist() for c in ("swap", "gain", "changed"))
    for a, z in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True):
        yield swap[a:z], gain[a:z], changed[a:z]


def _sums(rows: DataFrame, run) -> dict[tuple[int, str, str], float]:
    """(source, character, swap) -> sum of n, of what run makes of the rows."""
    got = rows.mapInArrow(run, "src bigint, mark string, swap string, n double").groupBy("src", "mark", "swap").agg(F.sum("n").alias("n"))
    t = fetched(got, "tables of swaps; a higher SUPPORT gives fewer")
    return {(s, u, swap): n for s, u, swap, n in zip(*(t[c].to_pylist() for c in ("src", "mark", "swap", "n")), strict=True)}


def _batch(sums: dict[tuple[int, str, str], float]) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int64()), *(pa.array([k[i] for k in keys], pa.string()) for i in (1, 2)), pa.array(list(sums.values()), pa.float64())],
        names=["src", "mark", "swap", "n"],
    )


def learn(held: DataFrame, kinds: DataFrame, events: DataFrame, iterations: int = ITERATIONS) -> Table:
    """The table after so many iterations. held: src and token of each distinct suspect of each source, kinds: the distinct suspects
    of all; events: src, marks, read and share (one over its number of sources) of those of a source that can be read back.

    Gathered is a sum per source, character and swap: as many rows as the table has.
    """
    spark = events.sparkSession

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str, str], float] = defaultdict(float)
        for b in batches:
            for src, token in zip(*(b.column(c).to_pylist() for c in ("src", "token")), strict=True):
                for u in set(_marks(token)):
                    sums[src, u, ""] += 1
        yield _batch(sums)

    own, every = held.where(F.col("src") != SMALL).select("src", "token"), kinds.select(F.lit(ALL).cast("bigint").alias("src"), "token")
    suspected = _sums(own.unionByName(every), marked)
    table: Table = {}
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(in_logs(table))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, str, str], float] = defaultdict(float)
            for b in batches:
                for src, marks, share, (swaps, gains, changed) in zip(*(b.column(c).to_pylist() for c in ("src", "marks", "share")), _readings(b), strict=True):
                    for swap, own, w in zip(swaps, changed, posterior(shared.value, src, marks, swaps, gains, changed)[1], strict=True):
                        if w > 1e-4:
                            for u in own:
                                if src != SMALL:
                                    sums[src, u, swap] += w
                                sums[ALL, u, swap] += w * share
            yield _batch(sums)

        sums = suspected | _sums(events.select("src", "marks", "share", "read"), run)
        of_all = {(u, swap): n for (src, u, swap), n in sums.items() if src == ALL}
        of_source = {key: n for key, n in sums.items() if key[0] >= 0}
        others = lambda n: max(0.0, n - 1)
        table = defaultdict(dict)
        for (u, swap), n in of_all.items():
            # under "": what a swap has that none of the suspects shows
            table[ALL, u][swap] = ((others(n) if swap else 0.0) + WEIGHT * START) / (others(of_all[u, ""]) + WEIGHT)
        for src, u, swap in list(of_source):
            if not swap:
                total = others(of_source[src, u, ""]) + WEIGHT
                for how, common in table[ALL, u].items():
                    own = others(of_source.get((src, u, how), 0.0)) if how else 0.0
                    table[src, u][how] = (own + WEIGHT * common) / total
        table = dict(table)
    return table


class Findings:
    """What the operator found in a table of documents."""

    def __init__(self, df: DataFrame) -> None:
        spark = df.sparkSession
        looked = checkpoint(first_look(df))
        counted = fetched(looked.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n")), "bigrams")
        lm = spark.sparkContext.broadcast((counted["key"].to_numpy(), counted["n"].to_numpy()))
        self.bigrams = lm
        tokens = looked.where("token IS NOT NULL").withColumn("id", F.xxhash64("left", "token", "right"))
        # where each distinct suspect stands: a few bytes for each source and language
        places = checkpoint(tokens.select("id", "src", "lang").distinct())
        supported = checkpoint(places.groupBy("src").count().where(F.col("count") >= SUPPORT).select("src"))
        own = _of_tables(places.select("id", "src"), supported).repartition("id").distinct()
        own = checkpoint(own.withColumn("share", 1 / F.count(F.lit(1)).over(Window.partitionBy("id"))))
        # few bytes, but much work for each: not to be coalesced by size. Tokens of the same characters go together, since what
        # the swaps make of these is remembered; single characters may be of very many tokens
        marks = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace("token", r"[\x00-\x7F]", ""), ""))), "")
        salt = F.pmod("id", F.when(F.length(marks) > 1, F.lit(4)).otherwise(F.lit(64)))
        kinds = tokens.select("id", "left", "token", "right").distinct().repartition(4 * spark.sparkContext.defaultParallelism, marks, salt)
        kinds = checkpoint(scored(kinds, lm))
        text = kinds.select("id", "left", "token", "right")
        told = fetched(learn_letters(places.where("lang <> 0").join(supported, "src", "left_semi").join(text, "id")), "letters of sources")
        #: By source: code point -> (letter, how much rarer the character is elsewhere).
        self.letters: dict[int, dict[int, tuple[str, float]]] = {}
        for src, mark, letter, rarer in zip(*(told[c].to_pylist() for c in ("src", "mark", "letter", "rarer")), strict=True):
            self.letters.setdefault(src, {})[ord(mark)] = letter, rarer
        # what can't be read back counts in the table, but never changes its mind
        readable = kinds if self.letters else kinds.where(F.size("read") > 0)
        events = own.join(readable, "id").select("left", "token", "right", "marks", "read", "share", "src")
        events = checkpoint((with_letters(events, self.letters, lm) if self.letters else events).where(F.size("read") > 0))
        self.table = learn(own.join(text.select("id", "token"), "id"), text, events)
        shared = spark.sparkContext.broadcast(in_logs(self.table))

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep, how, before, sure = [], [], [], []
                was = b.column("read").flatten().field("before").to_pylist()
                begin = 0
                for i, (src, marks, (swaps, gains, changed)) in enumerate(zip(b.column("src").to_pylist(), b.column("marks").to_pylist(), _readings(b), strict=True)):
                    stands, each = posterior(shared.value, src, marks, swaps, gains, changed)
                    if stands < 0.5:
                        best = max(range(len(each)), key=lambda k: (swaps[k] != LOST, each[k]))
                        keep.append(i)
                        how.append(swaps[best])
                        before.append(was[begin + best])
                        sure.append(1 - stands)
                    begin += len(swaps)
                rows = b.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("src", "left", "token", "right")), pa.array(how, pa.string()), pa.array(before, pa.string()), pa.array(sure, pa.float64())],
                    names=["src", "left", "token", "right", "swap", "before", "sure"],
                )

        #: src, left, token, right, swap, before, sure of each garbled token.
        self.tokens = checkpoint(events.mapInArrow(decide, "src bigint, left int, token string, right int, swap string, before string, sure double"))
        #: doc_id, src, left, token, right of the places where they may stand.
        self.suspects = suspects(df, self.tokens, np.sort(fetched(supported, "sources with a table")["src"].to_numpy()))

    def documents(self) -> DataFrame:
        """doc_id of each affected document."""
        return self.suspects.join(self.tokens, ["src", "left", "token", "right"], "left_semi").select("doc_id").distinct()

    def mapping(self) -> DataFrame:
        """src, mark, swap, p: the learned tables."""
        rows = [(s, u, swap, float(p)) for (s, u), t in self.table.items() for swap, p in t.items() if s >= 0 and swap and p >= 0.01]
        return self.suspects.sparkSession.createDataFrame(rows, "src bigint, mark string, swap string, p double")

    def restored(self, df: DataFrame) -> DataFrame:
        """doc_id and text of the affected documents, as far as it can be had back."""
        per_doc = (
            self.suspects.join(self.tokens.drop("sure"), ["src", "left", "token", "right"])
            .groupBy("doc_id").agg(F.collect_set(F.struct("token", "swap", "before")).alias("found"))
        )
        kind, lm = df.schema["doc_id"].dataType.simpleString(), self.bigrams

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = bigrams.Bigrams(*lm.value)
            for b in batches:
                texts = [restore(t, {f["token"]: f["swap"] for f in found}, model, {f["token"]: f["before"] for f in found}) for t, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

        return df.select("doc_id", "text").join(per_doc, "doc_id").mapInArrow(run, f"doc_id {kind}, text string")


def restore(text: str, swaps: dict[str, str], model: bigrams.Bigrams, before: dict[str, str] | None = None) -> str:
    """text with its garbled tokens (given with zeros for digits) read back, and those that one of their swaps makes likelier.

    before: what the tokens were; single-byte swaps may have hit one of their characters only.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    s = bigrams.symbols(cp)
    inside = (s != bigrams.BLANK) & (s != bigrams.EAST)
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    usual = [x for x in dict.fromkeys(swaps.values()) if x not in (LOST, LEARNED)]
    out, at = [], 0
    for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        token = text[i:j]
        if token.isascii():
            continue
        key = "".join("0" if "0" <= c <= "9" else c for c in token)
        swap = swaps.get(key)
        if swap and swap != LOST:
            was = (before or {}).get(key)
            if was is not None and (swap == LEARNED or swap in dict(codepages.swaps())):
                best = "".join(c if c < "\x80" else w for c, w in zip(token, was, strict=True))
            else:
                best = codepages.undo(token, swap)
        else:
            left, right = int(s[i - 1]) if i else bigrams.BLANK, int(s[j]) if j < len(s) else bigrams.BLANK
            options = [token, *(codepages.undo(token, x) for x in usual)]
            gains = model.scores(np.full(len(options), left), options, np.full(len(options), right))
            best = options[int(gains.argmax())]
        if best != token:
            out += [text[at:i], best]
            at = j
    return "".join([*out, text[at:]])


def found(df: DataFrame) -> DataFrame:
    """doc_id of the documents whose text holds characters from a wrong decoding. df: doc_id, text, source."""
    return Findings(df).documents()
