"""Filling fixed-capacity containers with items (problem 9): hierarchical residual packing.

Sizes are tokens of a public tokenizer. An item larger than the capacity is cut into full containers and a rest, which is
an item like others; nothing else is cut. Each task packs its own items by best fit, largest first, and gives out the bins
that are nearly full. The underfull bins go on as items of their filled size: in each round they are spread over groups
of at most GROUP bins, packed by best fit again, and the nearly full ones given out. Rounds go on while they make the
underfull bins fewer by a tenth, ROUNDS at most; then all are given out. No task holds more than a group, and bins that
can't be filled any further don't go round for ever.

Defined results: null and empty texts are no items. Equal items are interchangeable; a null or repeated doc_id is carried along. No items: no bins. A capacity below 1 is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.encode import token_counts
from seriesmill.llm.merges import TOKENIZERS
from seriesmill.session import checkpoint

#: Bins are nearly full from (1 - 1 / NEARLY) of the capacity on.
NEARLY = 128
#: Most underfull bins that are packed in one task.
GROUP = 200_000
#: Most rounds. With a tenth fewer bins each time, so many leave a thousandth of them underfull.
ROUNDS = 63
#: Most classes of bins; they are configuration.
MOST_CLASSES = 1000
ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("first", pa.int64()), ("tokens", pa.int64())])
BINS = "bin_class string, bin string, full boolean, filled bigint, items array<struct<doc_id:bigint,piece:int,first:bigint,tokens:bigint>>"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(bin of each item, number of bins): largest items first, each into the fullest bin that has room.

    Bins stand in lists by what is left of them; a bit mask tells which lists aren't empty.
    """
    place = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        room = mask >> size
        if room:
            left = (room & -room).bit_length() - 1 + size
            held = open_bins[left]
            b = held.pop()
            if not held:
                mask ^= 1 << left
        else:
            left, b = capacity, count
            count += 1
        place[i] = b
        left -= size
        if left:
            open_bins[left].append(b)
            mask |= 1 << left
    return place, count


def _bins(name: str, capacity: int, label: str, place: np.ndarray, count: int, sizes: np.ndarray, items: pa.Array, per: np.ndarray) -> pa.RecordBatch:
    """Rows of BINS. items: of all things packed, one after another; per: number of items of each."""
    filled = np.bincount(place, weights=sizes, minlength=count).astype(np.int64)
    of_bin = np.repeat(place, per)
    order = np.argsort(of_bin, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(of_bin, minlength=count))))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items.take(pa.array(order)))
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * count), pa.array([f"{label}-{b}" for b in range(count)]), pa.array(filled >= capacity - capacity // NEARLY), pa.array(filled), lists],
        names=["bin_class", "bin", "full", "filled", "items"],
    )


def _pack_items(ids: pa.Array, tokens: np.ndarray, name: str, capacity: int, label: str) -> Iterator[pa.RecordBatch]:
    pieces = np.maximum(1, -(-tokens // capacity))
    doc = ids.take(pa.array(np.repeat(np.arange(len(tokens)), pieces)))
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = nth * capacity
    size = np.minimum(np.repeat(tokens, pieces) - first, capacity)
    items = pa.StructArray.from_arrays([doc, pa.array(nth, pa.int32()), pa.array(first), pa.array(size)], fields=list(ITEM))
    place, count = best_fit(size, capacity)
    yield _bins(name, capacity, label, place, count, size, items, np.ones(len(size), np.int64))


def _classes(bins: DataFrame) -> list[tuple[str, int]]:
    rows = bins.select("bin_class", "capacity").limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES or any(r["capacity"] is None or r["capacity"] < 1 for r in rows):
        raise ValueError(f"more than {MOST_CLASSES} classes of bins, or a capacity below 1")
    return sorted((r["bin_class"], r["capacity"]) for r in rows)


def _first_round(counts: DataFrame, classes: Sequence[tuple[str, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        part = 0

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            ids = pa.concat_arrays(t["doc_id"].chunks)
            for c, (name, capacity) in enumerate(classes):
                yield from _pack_items(ids, t["tokens"].to_numpy(), name, capacity, f"0-{task}-{part}-{c}")

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= GROUP:
                yield from out()
                held, part, rows = [], part + 1, 0
        if held:
            yield from out()

    return counts.mapInArrow(run, BINS)


def _round(underfull: DataFrame, capacity_of: dict[str, int], nth: int, groups: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        name, part = t["bin_class"][0].as_py(), t["part"][0].as_py()
        lists = t["items"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = t["filled"].to_numpy()
        place, count = best_fit(sizes, capacity_of[name])
        per = np.diff(lists.offsets.to_numpy())
        return pa.Table.from_batches([_bins(name, capacity_of[name], f"{nth}-{part}", place, count, sizes, lists.flatten(), per)])

    part = F.pmod(F.xxhash64("bin"), F.lit(groups)).alias("part")
    return underfull.select("*", part).groupBy("bin_class", "part").applyInArrow(run, BINS)


def pack_sizes(counts: DataFrame, bins: DataFrame, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """bin_class, bin, filled, doc_id, piece, first, tokens: each item (or piece of one) in its bin. counts: doc_id, tokens."""
    classes = _classes(bins)
    capacity_of = dict(classes)
    counts = counts.where("tokens > 0").select(F.col("doc_id").cast("bigint"), F.col("tokens").cast("bigint"))
    done, now, before = [], checkpoint(_first_round(counts, classes)), None
    for nth in range(1, rounds + 1):
        done.append(now.where("full"))
        left = now.where("NOT full")
        per_class = left.groupBy("bin_class").count().collect()
        most = max((r["count"] for r in per_class), default=0)
        total = sum(r["count"] for r in per_class)
        if not total or before is not None and total > 0.9 * before:
            done.append(left)
            break
        before = total
        now = checkpoint(_round(left, capacity_of, nth, -(-most // group)))
    else:
        done.append(now)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("bin_class", "bin", "filled", F.explode("items").alias("i")).select("bin_class", "bin", "filled", "i.doc_id", "i.piece", "i.first", "i.tokens")


def sizes(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and tokens of the documents with a text, worked out once."""
    texts = documents.where(F.octet_length("text") > 0)
    return checkpoint(token_counts(texts, tokenizer=tokenizer, folder=folder))


def pack(documents: DataFrame, bins: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """pack_sizes over the documents' texts."""
    return pack_sizes(sizes(documents, tokenizer, folder), bins)


def audit(packed: DataFrame, counts: DataFrame, bins: DataFrame) -> DataFrame:
    """bin_class, documents, overfull, cut, lost: what the result holds, and the bins and documents that break a rule.

    overfull: bins above the capacity; cut: documents in more pieces than their size asks for; lost: documents whose pieces
    don't add up to their size. Documents are told apart by doc_id, which must be unique.
    """
    classes = bins.select("bin_class", "capacity")
    full = packed.groupBy("bin_class", "bin").agg(F.sum("tokens").alias("filled")).join(F.broadcast(classes), "bin_class")
    overfull = full.groupBy("bin_class").agg(F.count_if(F.col("filled") > F.col("capacity")).alias("overfull"))
    held = packed.groupBy("bin_class", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("held"))
    every = F.array(*[F.struct(F.lit(n).alias("bin_class"), F.lit(c).cast("bigint").alias("capacity")) for n, c in _classes(bins)])
    wanted = counts.where("tokens > 0").select("doc_id", "tokens", F.inline(every))
    each = wanted.join(held, ["bin_class", "doc_id"], "left")
    per = each.groupBy("bin_class").agg(
        F.count("pieces").alias("documents"),
        F.count_if(F.col("pieces") > F.ceil(F.col("tokens") / F.col("capacity"))).alias("cut"),
        F.count_if(F.coalesce("held", F.lit(0)) != F.col("tokens")).alias("lost"),
    )
    return per.join(overfull, "bin_class").select("bin_class", "documents", "overfull", "cut", "lost")
