"""Implausible values: planted cases, decoys, the chain itself, and its part in the decision."""

import random

import numpy as np
from pyspark.sql import functions as F

from seriesmill.operators import messages, spikes

LIMITS = [{"regexp": r"\.percent(\.|\?|$)", "lo": 0.0, "hi": 100.0}]
BEGIN = 1729814400


def course(n, rng, level=50.0):
    return [float(level + 5 * np.sin(i / 60) + rng.gauss(0, 0.3)) for i in range(n)]


def flagged(graphite, values, path="a.percent", step=60, begin=BEGIN):
    rows = [(i, path, v, begin + i * step, begin + i * step) for i, v in enumerate(values)]
    return {r.seq: r.flag for r in spikes.implausible(graphite(rows), LIMITS).collect()}


def test_spikes(graphite):
    rng = random.Random(1)
    v = course(600, rng)
    v[100] += 20
    v[200:205] = [x - 15 for x in v[200:205]]
    v[300] = float("inf")
    v[301] = 150.0
    v[302] = None
    v[303] = float("nan")
    for i in range(400, 415):
        v[i] = 49.25
    for i in range(450, 461):
        v[i] = 54.7  # eleven: not stuck
    v[500:] = [x + 12 for x in v[500:]]  # a lasting change
    want = {100: "spike", **{i: "spike" for i in range(200, 205)}, 300: "out of range", 301: "out of range", **{i: "stuck" for i in range(400, 415)}}
    assert flagged(graphite, v) == want


def test_normal_oddities(graphite):
    rng = random.Random(2)
    constant = [3.0] * 300
    assert flagged(graphite, constant) == {}
    mostly = [0.0 if rng.random() < 0.9 else float(rng.randint(2, 4)) for _ in range(400)]
    assert flagged(graphite, mostly) == {}
    assert flagged(graphite, [1.0, 500.0, 1.0]) == {1: "out of range"}
    assert flagged(graphite, [], "x") == {}
    assert flagged(graphite, [float("inf"), None], "x") == {0: "out of range"}


def test_daily_course(graphite):
    """A peak of every day is normal, also where it is long enough on some days to be a level; the same peak on one day isn't."""
    rng = random.Random(2)
    daily = course(4 * 144, rng)
    for d in range(4):
        for i in range(d * 144 + 40, d * 144 + 44):
            daily[i] += 9
    assert flagged(graphite, daily, step=600) == {}
    once = course(4 * 144, rng)
    once[144 + 40 : 144 + 44] = [x + 9 for x in once[144 + 40 : 144 + 44]]
    assert flagged(graphite, once, step=600) == {i: "spike" for i in range(184, 188)}
    longer = course(4 * 360, rng)
    for d, n in enumerate((11, 14, 11, 14)):
        for i in range(d * 360 + 100, d * 360 + 100 + n):
            longer[i] += 8
    assert flagged(graphite, longer, step=240) == {}


def test_ends_of_a_series(graphite):
    """After a spike the series returns: what it begins or ends with isn't one. Midnight is no end."""
    rng = random.Random(3)
    v = course(300, rng)
    v[0] += 30
    v[-2:] = [x + 30 for x in v[-2:]]
    assert flagged(graphite, v) == {}
    v = course(4000, rng)
    at = [86400 * k // 600 + j for k, j in ((3, -2), (5, -1), (5, 0), (9, 1))]
    for i in at:
        v[i] += 20
    assert flagged(graphite, v, step=600) == {i: "spike" for i in at}
    v = course(400, rng)
    for i in range(138, 152):  # stuck over midnight
        v[i] = 52.5
    assert flagged(graphite, v, step=600) == {i: "stuck" for i in range(138, 152)}


def test_sparse_series(graphite):
    """A reading a day: the level comes from other days."""
    rng = random.Random(4)
    v = [50 + rng.gauss(0, 0.3) for _ in range(90)]
    v[40] += 30
    assert flagged(graphite, v, step=86400) == {40: "spike"}


def test_copies_of_a_series_spread(graphite, spark):
    """Fifty copies of each message, met in many tasks: after the tasks' settling they are spread by message, not by path."""
    rng = random.Random(5)
    v = course(800, rng)
    v[100] += 20
    rows = [(c * 1000 + i, "a.percent", x, BEGIN + i * 60, BEGIN + i * 60 + c) for c in range(50) for i, x in enumerate(v)]
    df = graphite(rows).repartition(25)
    kept = messages.kept_rows(df, "seq").collect()
    assert sorted(r.seq for r in kept) == list(range(800))
    narrow = messages.keyed(df).select(*messages.id_hashes(F.col("_path"), F.col("Time")), "_arrival", "_seq")
    placed = messages.settle(narrow).repartition(8, "_k1", "_k2").groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in placed.collect()]
    assert sum(sizes) > 5 * 800 and max(sizes) < 2 * sum(sizes) / 8
    assert {r.seq: r.flag for r in spikes.implausible(df, LIMITS).collect()} == {100: "spike"}


def _chain_of(n, seed):
    rng = np.random.default_rng(seed)
    p = np.tile(spikes.PRIOR, (1, 1))
    p[0, spikes.BEGIN], p[0, spikes.STAY] = 0.01, 0.6
    e = spikes.emissions(rng.normal(size=n) * np.where(rng.random(n) < 0.02, 15, 1), rng.random(n) < 0.1, np.zeros(n, bool), np.repeat(p, n, axis=0))
    return p, e


def test_forward_backward_long_rows():
    n = 3 * spikes.ROW + 17
    p, e = _chain_of(n, 0)
    steps = spikes.transitions(p)
    assert np.allclose(steps.sum(axis=2), 1)
    cut, counts = spikes.forward_backward(e, np.zeros(n, int), np.ones(n, bool), steps, count=True)
    alpha, beta = np.empty((n, 4)), np.empty((n, 4))
    a = spikes.FIRST
    for i in range(n):
        a = (a if i == 0 else a @ steps[0]) * e[i]
        alpha[i] = a = a / a.sum()
    b = np.ones(4)
    for i in range(n - 1, -1, -1):
        beta[i] = b
        b = steps[0] @ (b * e[i])
        b /= b.sum()
    whole = alpha * beta
    whole /= whole.sum(axis=1, keepdims=True)
    assert np.abs(cut - whole).max() < 1e-3
    pairs = [alpha[i - 1][:, None] * steps[0] * (beta[i] * e[i])[None] for i in range(1, n)]
    assert np.abs(counts[0] - sum(x / x.sum() for x in pairs)).max() < 0.05


def _decide(z, p=None, same=None):
    n = len(z)
    value = np.asarray(z, float)
    one = np.zeros(1, bool)
    return spikes.decide(
        np.zeros(n, int), np.arange(n) * 60, value, np.ones(n, bool), spikes.PRIOR[None] if p is None else p, np.array([-np.inf]), np.array([np.inf]), one, one,
        (np.zeros(0, int),) * 4,
    )


def test_the_chain_decides(monkeypatch):
    """Without the chain, each reading for itself, other flags come out: a lone middling deviation, and one within a spike."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=300)
    z[100], z[200:206] = 11.0, (25, 24, 4.5, 25, 26, 24)
    with_chain = np.flatnonzero(_decide(z) == spikes.SPIKE).tolist()
    assert with_chain == list(range(200, 206))
    monkeypatch.setattr(spikes, "transitions", lambda p: np.full((len(p), 4, 4), 0.25))
    monkeypatch.setattr(spikes, "FIRST", np.full(4, 0.25))
    alone = np.flatnonzero(_decide(z) == spikes.SPIKE).tolist()
    assert 100 in alone and 202 not in alone


def test_parameters_are_the_series_own(monkeypatch):
    """The same deviation is a spike of a quiet series and none of one with wide tails or with the prior's."""
    rng = np.random.default_rng(2)
    quiet, wild = rng.normal(size=20000), rng.standard_t(2.5, size=20000)
    fitted = []
    for z in (quiet, wild):
        seen = np.bincount(spikes.bins_of(z[np.abs(z) < 12]), minlength=spikes.BINS).astype(float)[None]
        fitted.append(spikes.fit(np.zeros((1, 4, 4)), seen, np.ones(1), np.full(1, 0.01)))
    assert fitted[0][0, spikes.TAIL_SPREAD] < fitted[1][0, spikes.TAIL_SPREAD] and fitted[0][0, spikes.TAIL] < fitted[1][0, spikes.TAIL]
    z = rng.normal(size=100)
    z[50] = 11.5
    assert [(_decide(z, p)[50]) for p in fitted] == [spikes.SPIKE, spikes.NORMAL]


def test_summaries_match_whole_series():
    """Noise from the days' histograms is that of all steps, up to the bins' width."""
    rng = np.random.default_rng(3)
    value = np.cumsum(rng.normal(size=5000))
    step = np.abs(np.diff(value))
    bins, n = np.unique(spikes.step_bin(step), return_counts=True)
    got = spikes._noise_of(np.zeros(len(bins), int), bins, n, np.zeros(1), np.ones(1))
    assert abs(got[0] / spikes.noise(np.zeros(5000, int), value, 1)[0] - 1) < 0.05
