"""Distinct counts and percentiles."""

import random

import numpy as np
import pytest

from seriesmill.llm import distinct, percentiles

INDEX = "Date date, Level bigint, Path string"


def test_distinct_small_is_exact(spark):
    import datetime as dt

    d = dt.date(2024, 1, 1)
    rows = spark.createDataFrame([(d, 1, "a"), (d, 1, "a"), (d, 2, "b"), (d, 1, None), (None, 1, "c"), (d, None, "")], INDEX)
    pairs = distinct.sketch(rows, "Path", ["Date", "Level"])
    got = {r.Date: (r.kept, r.estimate, r.low, r.high, r.exact) for r in distinct.estimates(distinct.merge(pairs, ["Date"]), ["Date"]).collect()}
    assert got == {d: (3, 3.0, 3.0, 3.0, True), None: (1, 1.0, 1.0, 1.0, True)}
    assert distinct.sketch(rows.where("false"), "Path", ["Date"]).count() == 0


def test_distinct_bounds_and_merging(spark):
    rows = spark.range(60000).selectExpr("cast(null as date) Date", "id % 3 Level", "concat('p', id % 20000) Path")
    whole = distinct.sketch(rows, "Path", ["Level"], 256).collect()
    halves = [distinct.sketch(part, "Path", ["Level"], 256) for part in rows.randomSplit([0.5, 0.5], 3)]
    assert sorted(distinct.merge(halves[0].unionByName(halves[1]), ["Level"], 256).collect()) == sorted(whole)
    both = distinct.merge_groupings(distinct.sketch(rows, "Path", ["Date", "Level"], 256), [["Date"], ["Level"]], 256)
    assert sorted(both.where("grouping = 'Level'").select("Level", "h").collect()) == sorted(whole)
    assert both.where("grouping = 'Date'").count() == 256
    for r in distinct.estimates(distinct.sketch(rows, "Path", ["Level"], 256), ["Level"], 256).collect():
        assert not r.exact and r.low < r.estimate < r.high and abs(r.estimate / 20000 - 1) < 4 / np.sqrt(254)


def test_distinct_bounds_cover(spark):
    rows = spark.range(200000).selectExpr("id % 100 g", "concat('p', id) Path")
    got = distinct.estimates(distinct.sketch(rows, "Path", ["g"], 64), ["g"], 64).collect()
    assert len(got) == 100 and sum(r.low <= 2000 <= r.high for r in got) >= 88


def test_distinct_sets(spark):
    side = lambda lo, hi: distinct.sketch(spark.range(lo, hi).selectExpr("1 AS g", "concat('p', id) Path"), "Path", ["g"], 512)
    r = distinct.set_estimates(side(0, 30000), side(20000, 50000), ["g"], 512).first()
    assert r.union_low <= 50000 <= r.union_high and r.both_low <= 10000 <= r.both_high and r.only_low <= 20000 <= r.only_high
    small = distinct.set_estimates(side(0, 30), side(20, 50), ["g"], 512).first()
    assert (small.union, small.both, small.only, small.only_low) == (50, 10, 20, 20)


def summary(values, error):
    v = np.sort(np.array(values, float))
    ranks = np.arange(1, len(v) + 1)
    keep = percentiles.kept(np.zeros(len(v), int), ranks, np.full(len(v), len(v)), error)
    return v[keep], ranks[keep], ranks[keep]


def merged(groups):
    """percentiles.merge of lists of summaries: group, value, low, high of all tuples."""
    parts = [(g, p) for g, own in enumerate(groups) for p in own]
    ends = np.concatenate(([0], np.cumsum([len(p[0]) for _, (p, _) in parts])))
    columns = [np.concatenate([p[i] for _, (p, _) in parts]) for i in range(3)]
    return percentiles.merge(np.array([g for g, _ in parts]), np.array([n for _, (_, n) in parts]), ends, *columns)


@pytest.mark.parametrize("seed", range(5))
def test_merged_ranks_hold(seed):
    rng = random.Random(seed)
    groups = [[rng.choice([rng.gauss(0, 1), rng.randint(0, 5)]) for _ in range(rng.choice([1, 2, 50, 3000]))] for _ in range(9)]
    other = [[rng.random() for _ in range(500)] for _ in range(3)]
    g, v, lo, hi = merged([[(summary(x, 0.01), len(x)) for x in own] for own in (groups, other)])
    assert np.all(np.diff(g) >= 0)
    for k, own in enumerate((groups, other)):
        value, low, high = v[g == k], lo[g == k], hi[g == k]
        every = np.sort(np.concatenate(own))
        first, last = np.searchsorted(every, value, side="left") + 1, np.searchsorted(every, value, side="right")
        assert np.all(np.diff(value) >= 0) and np.all(low <= high) and np.all(np.diff(low) >= 0) and np.all(np.diff(high) >= 0)
        assert np.all((low <= last) & (high >= first))
        gaps = high[1:] - low[:-1]
        assert gaps.max() <= 2 * 0.01 * len(every) / percentiles.LEVELS + len(own)


def test_exact_summaries_merge_exactly():
    rng = random.Random(1)
    own = [[rng.randint(0, 9) for _ in range(20)] for _ in range(4)]
    _, v, lo, hi = merged([[(summary(x, 1e-9), 20) for x in own]])
    assert v.tolist() == sorted(sum(own, [])) and lo.tolist() == hi.tolist() == list(range(1, 81))


def test_quantiles_within_error(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "BLOCK_TUPLES", 3000)
    rows = spark.range(200000).selectExpr("concat('p', id % 3) path", "cast(id % 5 as int) day", "pow(rand(7), 3) * 1000 value").persist()
    parts = percentiles.merged(percentiles.summaries(rows.repartition(7)), ["path", "day"])
    assert parts.count() == 15
    for key in ("path", "day"):
        found = percentiles.quantiles(percentiles.by_key(parts, key), [key]).persist()
        for r in found.collect():
            want = max(1, int(np.ceil(r.q * r.n)))
            assert max(abs(r.rank_low - want), abs(r.rank_high - want)) <= percentiles.ERROR * r.n + 1
            if r.q == 0.5:
                values = np.sort([x.value for x in rows.where(rows[key] == r[key]).select("value").collect()])
                assert r.rank_low <= np.searchsorted(values, r.value, side="right") <= r.rank_high
        held = percentiles.ranks_hold(found, rows, key).collect()
        assert len(held) == found.count() and all(r.holds for r in held)
        wrong = found.withColumn("value", found.value + 0.001)
        assert not any(r.holds for r in percentiles.ranks_hold(wrong, rows, key).collect())


def test_quantiles_tiny(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 5.0), ("b", 1, 1.0)], "path string, day int, value double").repartition(2)
    parts = percentiles.merged(percentiles.summaries(rows), ["path", "day"])
    got = {(r.path, r.q): (r.value, r.rank_low, r.rank_high) for r in percentiles.quantiles(parts, ["path"], [0.5]).collect()}
    assert got == {("a", 0.5): (5.0, 1, 1), ("b", 0.5): (1.0, 1, 1)}
    assert percentiles.quantiles(percentiles.by_key(percentiles.summaries(rows.where("false")), "day"), ["day"]).count() == 0


def test_readings_once(graphite):
    """Copies, nulls and values that are no readings don't count; the path is canonical."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, "m;b=2;a=1", 5.0, 60, 70), (2, "m?a=1&b=2", 6.0, 60, 60), (3, "a..b", nan, 60, 70), (4, "a.b", inf, 61, 70), (5, None, 1.0, 60, 70), (6, "a.b", None, 62, 70), (7, "a.b", -1.0, 86463, 70)]
    got = percentiles.readings(graphite(rows)).collect()
    assert sorted((r.path, r.day, r.value) for r in got) == [("a.b", 1, -1.0), ("m?a=1&b=2", 0, 6.0)]


def test_one_hot_key(spark):
    """One path with most rows, in many tasks: every part that is shuffled is bounded."""
    rows = spark.range(120000).selectExpr("if(id % 10 < 9, 'hot', concat('p', id % 50)) path", "1 day", "cast(id % 1000 as double) value").repartition(12)
    parts = percentiles.summaries(rows)
    sizes = [len(r.value) for r in parts.where("path = 'hot'").collect()]
    assert sum(sizes) < 12 * (percentiles.LEVELS / percentiles.ERROR + 2) and len(sizes) == 12
    median = percentiles.quantiles(percentiles.merged(parts, ["path", "day"]), ["path"], [0.5]).where("path = 'hot'").first()
    assert median.n == 108000 and abs(median.value - 500) < 1000 * percentiles.ERROR + 1
