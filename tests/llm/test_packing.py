"""Bins: nothing lost, nothing over capacity, close to the least number."""

import random
from collections import defaultdict

import numpy as np
import pytest

from seriesmill.llm import packing

CLASSES = [("tiny", 16), ("large", 100)]


def pack(spark, sizes, classes=CLASSES, group=packing.GROUP, parts=3):
    counts = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens bigint").repartition(parts)
    bins = spark.createDataFrame(classes, "bin_class string, capacity bigint")
    return packing.pack_sizes(counts, bins, group).collect()


def check(rows, sizes, classes=CLASSES):
    used = {}
    for name, capacity in classes:
        own = [r for r in rows if r.bin_class == name]
        filled, pieces = defaultdict(int), defaultdict(list)
        for r in own:
            filled[r.bin] += r.tokens
            pieces[r.doc_id].append((r.piece, r["first"], r.tokens))
        assert all(f <= capacity for f in filled.values()) and all(r.filled == filled[r.bin] for r in own)
        assert set(pieces) == {i for i, s in enumerate(sizes) if s}
        for doc, ps in pieces.items():
            at = 0
            for k, (piece, first, tokens) in enumerate(sorted(ps)):
                assert (piece, first) == (k, at) and tokens > 0
                at += tokens
            assert at == sizes[doc]
            # only what is larger than the capacity is cut, and into as few pieces as can be
            assert len(ps) == -(-sizes[doc] // capacity)
        used[name] = len(filled)
    return used


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, rng.randint(1, 16), rng.randint(1, 300)]) for _ in range(700)]
    used = check(pack(spark, sizes), sizes)
    for name, capacity in CLASSES:
        rest = np.array([s % capacity for s in sizes if s % capacity])
        _, whole = packing.best_fit(rest, capacity)
        full = sum(s // capacity for s in sizes)
        assert used[name] <= (whole + full) * 1.03 + 2


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_no_round_loses_items(spark, rounds):
    """When the rounds end while they still help, what is underfull is given out as it is."""
    rng = random.Random(10)
    sizes = [rng.randint(1, 60) for _ in range(600)]
    counts = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens bigint").repartition(8)
    bins = spark.createDataFrame(CLASSES, "bin_class string, capacity bigint")
    packed = packing.pack_sizes(counts, bins, 20, rounds)
    check(packed.collect(), sizes)
    got = {r.bin_class: (r.documents, r.overfull, r.cut, r.lost) for r in packing.audit(packed, counts, bins).collect()}
    assert got == {name: (600, 0, 0, 0) for name, _ in CLASSES}
    spoilt = packed.where("doc_id <> 7").withColumn("tokens", packed.tokens + (packed.doc_id == 8).cast("bigint"))
    assert [r.lost for r in packing.audit(spoilt, counts, bins).collect()] == [2, 2]


def test_many_rounds_in_small_groups(spark):
    rng = random.Random(9)
    sizes = [rng.randint(1, 60) for _ in range(600)]
    used = check(pack(spark, sizes, group=20, parts=8), sizes)
    assert used["large"] <= sum(sizes) / 100 * 1.15 + 8


def test_bins_that_cannot_be_filled(spark):
    sizes = [60] * 200  # no two fit together
    assert check(pack(spark, sizes, [("large", 100)], group=20), sizes, [("large", 100)]) == {"large": 200}


def test_one_size_and_nothing(spark):
    assert check(pack(spark, [16] * 50), [16] * 50)["tiny"] == 50
    assert pack(spark, [0, 0]) == []
    with pytest.raises(ValueError):
        pack(spark, [1], [("x", 0)])


def test_null_and_repeated_ids(spark):
    counts = spark.createDataFrame([(None, 5), (1, 5), (1, 5), (2, None)], "doc_id bigint, tokens bigint")
    rows = packing.pack_sizes(counts, spark.createDataFrame([("c", 9)], "bin_class string, capacity bigint")).collect()
    assert sorted((r.doc_id or 0, r.tokens) for r in rows) == [(0, 5), (1, 5), (1, 5)]


def test_best_fit_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randint(1, 30)
        sizes = np.array([rng.randint(1, capacity) for _ in range(rng.randint(0, 40))], np.int64)
        place, count = packing.best_fit(sizes, capacity)
        left = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [k for k, room in enumerate(left) if room >= s]
            if fits:
                left[min(fits, key=lambda k: left[k])] -= s
            else:
                left.append(capacity - s)
        filled = np.bincount(place, weights=sizes, minlength=count)
        assert count == len(left) and sorted(capacity - filled) == sorted(left)


def test_pack_texts(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, " "), (5, "word " * 300)], "doc_id bigint, text string")
    rows = packing.pack(docs, spark.createDataFrame([("c", 64)], "bin_class string, capacity bigint")).collect()
    assert {r.doc_id for r in rows} == {1, 4, 5} and max(r.filled for r in rows) <= 64
