"""Percentiles of very large numeric columns (problem 6): mergeable rank-interval summaries.

A summary of n values is a list of tuples (value, low, high): the value's rank among the n lies between low and high.
Sorted values give a summary without uncertainty. Of the tuples whose low falls in the same stretch of ranks only the first
is kept, and the greatest of all: so a summary of level j has neighbours whose intervals span at most 2 * ERROR * (j + 1) /
LEVELS * n, and every rank is known within half of that. Merging adds the bounds: a value's rank in the whole is its rank in
its own summary plus that of the greatest value not above it in each other one. In order of value these sums change by one
tuple at a time, so they are running sums, and many groups are merged at once.

Level 0 is what one task reads of a path and day, summarised before anything is shuffled; level 1 a path's day; level 2 what
a task holds of a key; level 3 parts of these; level 4 their union. Each result carries its own rank bounds.

Copies are settled first, by identifiers alone (deletion vectors). A path and day then has at most 86,400 values; no group
of a merge is larger than the number of tasks over PARTS.

Defined results: null, NaN and infinite values aren't readings, nor is what stands at a Time beyond 32 bits of days. Of n values the q-quantile is the value of rank
ceil(q * n), at least 1. Groups without readings have no row; equal values are kept as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.paths import canonical_path
from seriesmill.operators.messages import exactly_once, in_blocks

#: Ranks are within ERROR * n of the asked ones.
ERROR = 0.005
LEVELS = 5
PARTS = 64
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
SUMMARY = "n bigint, value array<double>, low array<bigint>, high array<bigint>"
#: Rows summarised, and tuples merged, at once.
BLOCK_ROWS, BLOCK_TUPLES = 1 << 19, 1 << 21


def readings(df: DataFrame) -> DataFrame:
    """path (canonical), day (UTC, days since 1970) and value of each reading, read without a shuffle: only identifiers are."""
    rows = exactly_once(df).where("Path IS NOT NULL AND Time IS NOT NULL AND Value IS NOT NULL AND NOT isnan(Value) AND abs(Value) < double('infinity')")
    return rows.select(canonical_path(F.col("Path")).alias("path"), F.expr("try_cast(floor(Time / 86400) AS int)").alias("day"), F.col("Value").alias("value")).where("day IS NOT NULL")


def kept(group: np.ndarray, low: np.ndarray, n: np.ndarray, error: float) -> np.ndarray:
    """Mask of the tuples that stay: the first in each stretch of ranks of a group, and its last. n: the group's size, for each tuple."""
    stretch = np.floor(low / np.maximum(2 * error / LEVELS * n, 1e-9))
    keep = np.ones(len(low), bool)
    new = group[1:] != group[:-1]
    keep[1:] = new | (stretch[1:] != stretch[:-1])
    keep[:-1] |= new
    keep[-1:] = True
    return keep


def merge(group: np.ndarray, sizes: np.ndarray, ends: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, value, low, high) of all tuples after merging the summaries of each group, sorted by group and value.

    A summary is a row of group (sorted, numbered from 0), sizes and ends; among equal values, those of earlier ones come first.
    """
    row = np.repeat(np.arange(len(group)), np.diff(ends))
    first = np.zeros(len(value), bool)
    first[ends[:-1][np.diff(ends) > 0]] = True
    before = np.where(first, 0, np.concatenate(([0], low[:-1])))
    last = np.ones(len(value), bool)
    last[:-1] = first[1:]
    # what the summary says of a value between this tuple and the next: its rank is at most that of the next, less one
    after = np.where(last, sizes[row], np.concatenate((high[1:], [0])) - 1)
    order = np.lexsort((row, value, group[row]))
    g = group[row][order]
    begin = np.searchsorted(g, g)
    up = np.cumsum((low - before)[order])
    down = np.cumsum((after - (high - 1))[order])
    start = np.bincount(group[row[first]], (high - 1)[first], int(group[-1]) + 1).astype(np.int64) if len(group) else np.zeros(0, np.int64)
    none = np.concatenate(([0], up)), np.concatenate(([0], down))
    merged_low = up - none[0][begin]
    merged_high = start[g] + none[1][:-1] - none[1][begin] + 1
    return g, value[order], merged_low, merged_high


def _lists(ends: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    at = pa.array(ends, pa.int32())
    return [pa.ListArray.from_arrays(at, pa.array(c, pa.float64() if c.dtype.kind == "f" else pa.int64())) for c in columns]


def _ends(group: np.ndarray, groups: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(group, minlength=groups))))


def _begins(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for k in keys:
        c = _column(t, k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, max(0, len(c) - 1))).to_numpy(zero_copy_only=False)
    return new


def _column(t: pa.Table, name: str) -> pa.Array:
    x = t[name].combine_chunks()
    return x.chunk(0) if isinstance(x, pa.ChunkedArray) else x


def summaries(rows: DataFrame, error: float = ERROR) -> DataFrame:
    """path, day and a summary of level 0 for what each task's block of rows holds of it. rows: path, day, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks((b for b in batches if b.num_rows), BLOCK_ROWS):
            path = b.column("path").dictionary_encode()
            code, day, value = path.indices.to_numpy(), b.column("day").to_numpy(), b.column("value").to_numpy()
            order = np.lexsort((value, day, code))
            code, day, value = code[order], day[order], value[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (day[1:] != day[:-1])
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            rank = np.arange(len(code)) - np.searchsorted(group, group) + 1
            keep = kept(group, rank, size[group], error)
            value, low, high = _lists(_ends(group[keep], len(size)), value[keep], rank[keep], rank[keep])
            names = path.dictionary.take(pa.array(code[new]))
            yield pa.RecordBatch.from_arrays([names, pa.array(day[new]), pa.array(size), value, low, high], names=["path", "day", "n", "value", "low", "high"])

    return rows.select("path", "day", "value").mapInArrow(run, f"path string, day int, {SUMMARY}")


def _merged(t: pa.Table, keys: Sequence[str], error: float) -> pa.RecordBatch:
    """One row for each combination of keys of a table sorted by them."""
    new = _begins(t, keys)
    group = np.cumsum(new) - 1
    sizes = t["n"].to_numpy()
    lists = [_column(t, c) for c in ("value", "low", "high")]
    ends = lists[0].offsets.to_numpy()
    g, value, low, high = merge(group, sizes, ends - ends[0], *(x.flatten().to_numpy() for x in lists))
    total = np.bincount(group, sizes).astype(np.int64)
    keep = kept(g, low, total[g], error)
    head = pa.array(np.flatnonzero(new))
    return pa.RecordBatch.from_arrays(
        [*(_column(t, k).take(head) for k in keys), pa.array(total), *_lists(_ends(g[keep], len(total)), value[keep], low[keep], high[keep])], names=[*keys, "n", "value", "low", "high"]
    )


def _schema(parts: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join([*(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys), SUMMARY])


def merged(parts: DataFrame, keys: Sequence[str], error: float = ERROR) -> DataFrame:
    """One summary, of one level more, for each combination of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tuples = 0
        for b in batches:
            if tuples >= BLOCK_TUPLES:  # up to the last group begun
                t = pa.Table.from_batches([*held, b]).combine_chunks()
                cut = int(np.flatnonzero(_begins(t, keys))[-1])
                if cut:
                    yield _merged(t.slice(0, cut).combine_chunks(), keys, error)
                    held = t.slice(cut).combine_chunks().to_batches()
                    tuples = sum(len(x.column("value").flatten()) for x in held)
                    continue
            held.append(b)
            tuples += len(b.column("value").flatten())
        if held and sum(b.num_rows for b in held):
            yield _merged(pa.Table.from_batches(held).combine_chunks(), keys, error)

    placed = parts.select(*keys, "n", "value", "low", "high").repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(run, _schema(parts, keys))


def within_tasks(parts: DataFrame, key: str, error: float = ERROR) -> DataFrame:
    """key and one summary, of one level more, for what each task holds of it; more than one where that is much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tuples = 0

        def out() -> pa.RecordBatch:
            return _merged(pa.Table.from_batches(held).sort_by(key).combine_chunks(), [key], error)

        for b in batches:
            held.append(b)
            tuples += len(b.column("value").flatten())
            if tuples >= BLOCK_TUPLES:
                yield out()
                held, tuples = [], 0
        if held and sum(b.num_rows for b in held):
            yield out()

    return parts.select(key, "n", "value", "low", "high").mapInArrow(run, _schema(parts, [key]))


def by_path_day(df: DataFrame, error: float = ERROR) -> DataFrame:
    """path, day and the summary of its readings: what the tasks read of it, merged."""
    return merged(summaries(readings(df), error), ["path", "day"], error)


def by_key(parts: DataFrame, key: str, error: float = ERROR) -> DataFrame:
    """The summaries of paths' days merged to one for each `key`, path or day."""
    salted = within_tasks(parts, key, error).select("*", F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("_part"))
    return merged(merged(salted, [key, "_part"], error), [key], error)


def quantiles(parts: DataFrame, keys: Sequence[str], at: Sequence[float] = QUANTILES) -> DataFrame:
    """keys, n, q, value, rank_low, rank_high: for each q the tuple whose interval lies nearest the asked rank."""
    kinds = _schema(parts, keys).removesuffix(f", {SUMMARY}")
    asked = np.asarray(at, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n").to_numpy()
            lists = [b.column(c) for c in ("value", "low", "high")]
            value, low, high = (x.flatten().to_numpy() for x in lists)
            ends = lists[0].offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            row = np.repeat(np.arange(len(n)), np.diff(ends))
            rows = np.arange(len(n))
            best = []
            for q in asked:
                want = np.maximum(1, np.ceil(np.round(q * n, 6))).astype(np.int64)
                off = np.maximum(np.abs(high - want[row]), np.abs(want[row] - low))
                order = np.lexsort((low, value, off, row))
                best.append(order[ends[:-1]])
            pick = np.stack(best, axis=1).reshape(-1)
            again = pa.array(np.repeat(rows, len(asked)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(again) for k in keys), b.column("n").take(again), pa.array(np.tile(asked, len(n))), pa.array(value[pick]), pa.array(low[pick]), pa.array(high[pick])],
                names=[*keys, "n", "q", "value", "rank_low", "rank_high"],
            )

    return parts.select(*keys, "n", "value", "low", "high").mapInArrow(run, f"{kinds}, n bigint, q double, value double, rank_low bigint, rank_high bigint")


def ranks_hold(found: DataFrame, rows: DataFrame, key: str, error: float = ERROR) -> DataFrame:
    """key, n, q and holds: whether the true ranks of the value lie within its bounds, and these within error * n of the asked rank.

    An exact check of quantiles by a second pass over the readings: each is counted in the interval between two of its key's
    values, before the shuffle, so that a key's readings never meet.
    """
    cuts = found.groupBy(key).agg(F.array_sort(F.collect_set("value")).alias("_cuts"))
    # at most as many cuts as quantiles: a place is how many of them lie below, and whether the reading equals one
    placed = rows.join(cuts, key).select(
        key, F.size(F.filter("_cuts", lambda c: c < F.col("value"))).alias("_below"), F.array_contains("_cuts", F.col("value")).alias("_same")
    )
    counted = placed.groupBy(key, "_below", "_same").agg(F.count(F.lit(1)).alias("_c"))
    per = counted.groupBy(key).agg(F.collect_list(F.struct("_below", "_same", "_c")).alias("_places"))
    nth = F.array_position("_cuts", F.col("value")) - 1  # cuts below the value
    total = lambda keep: F.aggregate(F.filter("_places", keep), F.lit(0).cast("bigint"), lambda a, x: a + x["_c"])
    less = total(lambda x: (x["_below"] < F.col("_nth")) | ((x["_below"] == F.col("_nth")) & ~x["_same"]))
    same = total(lambda x: (x["_below"] == F.col("_nth")) & x["_same"])
    want = F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("n"), 6)))
    joined = found.join(cuts, key).join(per, key).withColumn("_nth", nth)
    joined = joined.withColumn("_less", less).withColumn("_same", same)
    inside = (F.col("_same") > 0) & (F.col("rank_low") <= F.col("_less") + F.col("_same")) & (F.col("rank_high") >= F.col("_less") + 1)
    near = F.greatest(F.abs(F.col("rank_high") - want), F.abs(want - F.col("rank_low"))) <= error * F.col("n") + 1
    return joined.select(key, "n", "q", (inside & near).alias("holds"))
