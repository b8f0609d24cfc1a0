"""Mixed timestamp formats and time zones (problem 2): one UTC second for each record that denotes one.

A token's shape mask has 9 for each digit and A for each letter; everything else stands for itself. Tokens of one mask
are equally long and have their fields at the same places, so each distinct mask is compiled to a parser once, and the
parser reads its fields as columns of a byte matrix. Wall-clock times go through the zone transition tables.

Defined results: null, blank, zero, negative and impossible timestamps (a 13th month, an hour the zone skips) denote no
instant, nor does a wall-clock time without a zone where the record's relay gives none. Instants are rounded down to
whole seconds. Of a time that occurs twice, the later instant not after `received` is meant (a null `received`: the
later one). Epoch numbers are seconds, milli-, micro- or nanoseconds by their size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.operators import zones

DIGITS, LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
#: Epoch numbers from 10^11, 10^14 and 10^17 on are milli-, micro- and nanoseconds.
SCALES = ((10**11, 1), (10**14, 1000), (10**17, 10**6), (10**19, 10**9))
LAST_SECOND = 253402300799  # the end of the year 9999

_TIME = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:\.9+)?)?(?: ?(?P<half>AA)(?![A/_]))?"
_TAIL = r"(?P<tail>A| ?[+-]99(?::?99)?| AA[A/_+\-]*|\[AA[A/_+\-]*\])?"
_SHAPES = [re.compile(p) for p in (
    rf"(?P<y>9999)[-/](?P<mo>99)[-/](?P<d>99)(?: |(?P<t>A)){_TIME}{_TAIL}",
    r"(?P<y>9999)(?P<mo>99)(?P<d>99)(?P<t>A)(?P<h>99)(?P<mi>99)(?P<s>99)(?:\.9+)?(?P<tail>A|[+-]99(?::?99)?)?",
    rf"(?P<p>99?)[./](?P<q>99?)[./](?P<y>9999) {_TIME}{_TAIL}",
    rf"(?:AAA, )?(?P<d>99?)[- ](?P<mon>AAA)[- ](?P<y>9999) {_TIME}{_TAIL}",
)]
_EPOCH = re.compile(r"9+")
_FRACTION = re.compile(r"(?P<whole>9+)\.9+")
_POWER = re.compile(r"(?P<m>9)(?:\.(?P<f>9+))?(?P<e>A)(?P<sign>[+-]?)(?P<x>99?)")


def shape_mask(token: Column) -> Column:
    return F.translate(token, DIGITS + LETTERS, "9" * len(DIGITS) + "A" * len(LETTERS))


@dataclass(frozen=True)
class Coded:
    """A column of texts: the distinct ones, and which of them each row has."""

    texts: list[str]
    which: np.ndarray

    @classmethod
    def of(cls, column: pa.Array | np.ndarray | list[str]) -> Coded:
        column = column if isinstance(column, pa.Array) else pa.array(column, pa.string())
        coded = pc.fill_null(column, "").dictionary_encode()
        return cls(coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False))

    def take(self, rows: np.ndarray) -> Coded:
        return Coded(self.texts, self.which[rows])

    def equals(self, text: str) -> np.ndarray:
        return np.array([t == text for t in self.texts], bool)[self.which] if self.texts else np.zeros(len(self.which), bool)


#: (byte matrix, zone, day order, latest instant) -> (UTC seconds, whether there is one)
Parser = Callable[[np.ndarray, Coded, Coded, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _number(m: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(m), np.int64)
    for i in range(*span):
        out = out * 10 + (m[:, i] - 48)
    return out


def _seconds_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = n // SCALES[-1][1]
    for limit, scale in reversed(SCALES[:-1]):
        out = np.where(n < limit, n // scale, out)
    return out, (out > 0) & (out <= LAST_SECOND)


def _days(y: np.ndarray, mo: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether there is such a date."""
    ok = (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1)
    month = ((np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, mo, 1) - 1).astype("datetime64[M]")
    first, after = month.astype("datetime64[D]").astype(np.int64), (month + 1).astype("datetime64[D]").astype(np.int64)
    return first + d - 1, ok & (d <= after - first)


@lru_cache(maxsize=1 << 16)
def compile_mask(mask: str) -> Parser | None:
    """The parser for all tokens of this mask, made once in a process; None where no such token denotes an instant."""
    if _EPOCH.fullmatch(mask):
        # nineteen digits may pass the largest integer
        return (lambda m, *_: _seconds_of(_number(m, (0, len(mask))))) if len(mask) < 19 else _nineteen if len(mask) == 19 else None
    if f := _FRACTION.fullmatch(mask):
        return (lambda m, *_: _seconds_of(_number(m, f.span("whole")))) if len(f["whole"]) < 19 else None
    if f := _POWER.fullmatch(mask):
        return lambda m, *_: _power(m, f)
    for shape in _SHAPES:
        if f := shape.fullmatch(mask):
            return lambda m, zone, order, latest, f=f: _wall_clock(m, zone, order, latest, f)
    return None


def _nineteen(m: np.ndarray, *_: object) -> tuple[np.ndarray, np.ndarray]:
    out = _number(m, (0, 10))
    return out, (out > 0) & (out <= LAST_SECOND)


def _power(m: np.ndarray, f: re.Match[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number in scientific notation, as epoch seconds up to the sizes of SCALES; exact, without floating point."""
    digits = _number(m, f.span("m"))
    places = 0
    if f["f"]:
        places = min(len(f["f"]), 17)
        digits = digits * 10**places + _number(m, (f.start("f"), f.start("f") + places))
    x = _number(m, f.span("x"))
    if f["sign"]:
        x = np.where(m[:, f.start("sign")] == ord("-"), -x, x)
    shift = x - places
    fits = (shift <= 18) & (shift >= -18)
    p = 10 ** np.clip(np.abs(shift), 0, 18)
    fits &= (shift <= 0) | (digits <= np.iinfo(np.int64).max // p)
    out, ok = _seconds_of(np.where(shift >= 0, digits * np.where(fits, p, 1), digits // p))
    return out, ok & fits & np.isin(m[:, f.start("e")], [ord("e"), ord("E")])


def _texts(m: np.ndarray, span: tuple[int, int]) -> Coded:
    cells = np.ascontiguousarray(m[:, span[0] : span[1]].astype(np.uint8)).view(f"S{span[1] - span[0]}").ravel()
    distinct, which = np.unique(cells, return_inverse=True)
    return Coded([t.decode("ascii") for t in distinct], which)


def _wall_clock(m: np.ndarray, zone: Coded, order: Coded, latest: np.ndarray, f: re.Match[str]) -> tuple[np.ndarray, np.ndarray]:
    has = f.groupdict()
    y = _number(m, f.span("y"))
    ok = np.ones(len(m), bool)
    if has.get("p"):
        p, q, mdy = _number(m, f.span("p")), _number(m, f.span("q")), order.equals("mdy")
        mo, d = np.where(mdy, p, q), np.where(mdy, q, p)
        ok &= mdy | order.equals("dmy")
    else:
        d = _number(m, f.span("d"))
        if has.get("mon"):
            name = _texts(m, f.span("mon"))
            mo = np.array([MONTHS.get(t.lower(), 0) for t in name.texts], np.int64)[name.which]
        else:
            mo = _number(m, f.span("mo"))
    if has.get("t"):
        ok &= np.isin(m[:, f.start("t")], [ord("T"), ord("t")])
    h, mi = _number(m, f.span("h")), _number(m, f.span("mi"))
    s = _number(m, f.span("s")) if has.get("s") else np.zeros(len(m), np.int64)
    if has.get("half"):
        half = _texts(m, f.span("half"))
        half = Coded([t.upper() for t in half.texts], half.which)
        ok &= (half.equals("AM") | half.equals("PM")) & (h >= 1) & (h <= 12)
        h = h % 12 + np.where(half.equals("PM"), 12, 0)
    days, real = _days(y, mo, d)
    ok &= real & (h < 24) & (mi < 60) & (s < 60)
    local = days * 86400 + h * 3600 + mi * 60 + s
    tail = (has.get("tail") or "").strip()
    if tail[:1] in ("+", "-"):
        at = f.start("tail") + len(f["tail"]) - len(tail)
        oh = _number(m, (at + 1, at + 3))
        om = _number(m, (f.end("tail") - 2, f.end("tail"))) if len(tail) > 3 else np.zeros(len(m), np.int64)
        ok &= (oh < 24) & (om < 60)
        utc = local - np.where(m[:, at] == ord("-"), -1, 1) * (oh * 3600 + om * 60)
    else:
        names = zone
        if tail:
            names = _texts(m, f.span("tail"))
            names = Coded([t.strip(" []") for t in names.texts], names.which)
        utc = np.zeros(len(m), np.int64)
        for k in np.unique(names.which).tolist():
            name, rows = names.texts[k], names.which == k
            found = np.zeros(int(rows.sum()), bool)
            if tail and (fixed := zones.ABBREVIATIONS.get(name.upper())) is not None:
                utc[rows], found = local[rows] - fixed, True
            elif name and (table := zones.transitions(name)) is not None:
                utc[rows], found = zones.local_to_utc(table, local[rows], latest[rows])
            ok[rows] &= found
    return utc, ok & (utc > 0)


def parse_tokens(
    tokens: pa.Array | list[str], masks: pa.Array | list[str], zone: pa.Array | np.ndarray, order: pa.Array | np.ndarray, latest: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of each token, and whether it denotes an instant. All of one mask are read together, from the column's own bytes."""
    tokens = tokens if isinstance(tokens, pa.Array) else pa.array(tokens, pa.string())
    utc, found = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    if not len(tokens):
        return utc, found
    begin = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens)].astype(np.int64)
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
    mask, zone, order = Coded.of(masks), Coded.of(zone), Coded.of(order)
    order_of = np.argsort(mask.which, kind="stable")
    ends = np.cumsum(np.bincount(mask.which, minlength=len(mask.texts)))
    for k, kind in enumerate(mask.texts):
        rows = order_of[ends[k - 1] if k else 0 : ends[k]]
        parser = compile_mask(kind)
        if parser is None or not kind.isascii():
            continue
        # a mask of ASCII is as long as its tokens
        m = data[begin[rows][:, None] + np.arange(len(kind))].astype(np.int64)
        utc[rows], found[rows] = parser(m, zone.take(rows), order.take(rows), latest[rows])
    return utc, found


def parsed(df: DataFrame, rec_id: str, token: str, zone: str, day_order: str, received: str) -> DataFrame:
    """rec_id, token (trimmed of white space), utc_s (null: it denotes no instant)."""
    known = zones.version()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if zones.version() != known:
            raise RuntimeError(f"zone data {zones.version()} here, {known} on the driver")
        for b in batches:
            latest = b.column("received").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            utc, found = parse_tokens(*(b.column(c) for c in ("token", "mask", "zone", "day_order")), latest)
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), b.column("raw"), pa.array(utc, mask=~found)], names=["rec_id", "raw", "utc_s"])

    tight = F.regexp_replace(F.coalesce(F.col(token), F.lit("")), r"^\s+|\s+\z", "")
    rows = df.select(
        F.col(rec_id).alias("rec_id"), F.col(token).alias("raw"), tight.alias("token"), shape_mask(tight).alias("mask"),
        F.col(zone).alias("zone"), F.col(day_order).alias("day_order"), F.col(received).cast("bigint").alias("received"),
    )
    return rows.mapInArrow(run, "rec_id bigint, raw string, utc_s bigint")


def epoch_seconds(n: Column) -> Column:
    """Whole seconds of an epoch number of any precision; null for null, zero and negative ones."""
    out = F.when(n < SCALES[0][0], n)
    for limit, scale in SCALES[1:]:
        whole = F.call_function("div", n, F.lit(scale))
        out = out.when(n < limit, whole) if limit < 10**19 else out.otherwise(whole)
    return F.when(n > 0, out)


def telegraf_instants(metrics: DataFrame, relays: DataFrame) -> DataFrame:
    """metric_id as rec_id, raw, utc_s: text without a zone is local time of the zone of tags.relay."""
    zone_of = relays.select(F.col("relay").alias("_relay"), F.col("zone").alias("_zone"), F.col("day_order").alias("_order"))
    rows = metrics.select("metric_id", "timestamp", "received", F.try_element_at("tags", F.lit("relay")).alias("_by"))
    return parsed(rows.join(zone_of, F.col("_by") == F.col("_relay"), "left"), "metric_id", "timestamp", "_zone", "_order", "received")


def day_start(time: Column) -> Column:
    return time - F.pmod(time, F.lit(86400))


def instants(points: DataFrame, samples: DataFrame, metrics: DataFrame, relays: DataFrame) -> DataFrame:
    """src, rec_id, utc_s and `changed` of every record that denotes an instant (of a point: its UTC day's start).

    changed: the record didn't already state it in its column's intended form (UTC day, milliseconds, ten digits).
    """
    utc_day = F.date_from_unix_date(F.floor(F.col("Time") / 86400).try_cast("int"))
    p = points.where("Time IS NOT NULL").select(
        F.lit("graphite").alias("src"), F.col("seq").alias("rec_id"), day_start(F.col("Time")).alias("utc_s"),
        (~F.col("Date").eqNullSafe(utc_day)).alias("changed"),
    )
    ms = (F.col("timestamp") >= SCALES[0][0]) & (F.col("timestamp") < SCALES[1][0])
    s = samples.select(
        F.lit("prom_sample").alias("src"), F.col("sample_id").alias("rec_id"), epoch_seconds(F.col("timestamp")).alias("utc_s"), (~ms).alias("changed")
    )
    t = telegraf_instants(metrics, relays).select(
        F.lit("telegraf_metric").alias("src"), "rec_id", "utc_s", (~F.col("raw").rlike(r"^[0-9]{10}\z")).alias("changed")
    )
    return p.unionByName(s.where("utc_s IS NOT NULL")).unionByName(t.where("utc_s IS NOT NULL"))
