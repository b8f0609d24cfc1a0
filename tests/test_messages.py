"""Messages, grid, late rows: against brute force, and the defined results."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from seriesmill.operators import grid, late, messages

NAN, INF = float("nan"), float("inf")


def some_rows(seed, n=400):
    rng = random.Random(seed)
    names = ["a.b", "a..b", "m;y=2;x=1", "m?x=1&y=2", "hot", None, ""]
    rows = []
    for i in range(n):
        at = rng.choice([0, None, rng.randint(90000, 130000)])
        chunk = rng.choice(["default.100000123456789", "default.120000999999999", "bad", None])
        rows.append((i, "hot" if rng.random() < 0.3 else rng.choice(names), rng.choice([None, NAN, INF, 1.0, rng.random()]), None if rng.random() < 0.05 else 86000 + rng.randint(0, 40) * 60, at, chunk))
    return rows


def arrival(row):
    if row[4]:
        return row[4]
    try:
        return int(row[5].split(".")[-1]) // 10**9
    except (AttributeError, ValueError):
        return None


def canonical(path):
    return {"a..b": "a.b", "m;y=2;x=1": "m?x=1&y=2"}.get(path, path)


def winners(rows):
    groups = defaultdict(list)
    for r in rows:
        if r[1] is not None and r[3] is not None:
            groups[canonical(r[1]), r[3]].append(r)
    order = lambda r: (arrival(r) is None, arrival(r) or 0, r[0])
    return {k: min(g, key=order) for k, g in groups.items()}


def test_deleted_and_kept(graphite, monkeypatch):
    for seed in (1, 2):
        rows = some_rows(seed)
        kept = {r[0] for r in winners(rows).values()}
        message = {r[0] for r in rows if r[1] is not None and r[3] is not None}
        df = graphite(rows, extra=[("_path", F.lit("x")), ("_seq", F.lit(1))])
        assert sorted(r["_seq"] for r in messages.deleted(df).collect()) == sorted(message - kept)
        once = messages.exactly_once(df)
        assert once.columns == df.columns
        assert sorted(r["seq"] for r in once.select("seq").collect()) == sorted(kept | {r[0] for r in rows} - message)
        monkeypatch.setattr(messages, "BLOCK_ROWS", 16)


def test_vectors_in_groups(graphite):
    rows = some_rows(3)
    df = graphite(rows)
    vectors = messages.deletion_vectors(df).persist()
    whole = messages.without_deleted(df, vectors).select("seq").collect()
    assert sorted(whole) == sorted(messages.without_deleted(df, vectors, broadcast_bytes=1).select("seq").collect())


def test_rows_alike_in_everything(graphite):
    df = graphite([(1, "p", 1.0, 60, 70), (1, "p", 1.0, 60, 70), (None, "p", 2.0, 60, 70)])
    assert messages.exactly_once(df).count() == 1
    assert [r.path for r in messages.kept_rows(df).collect()] == ["p"]


def test_empty(graphite, spark):
    df = graphite([(1, "p", 1.0, 60, 70)]).where("false")
    assert messages.kept_rows(df).count() == 0 and late.late_rows(df).count() == 0 and late.revisions(df).count() == 0
    assert grid.on_grid(df, []).count() == 0


def test_late_against_brute_force(graphite):
    rows = some_rows(4)
    want = {}
    for (_, time), r in winners(rows).items():
        end, at = (time // 3600 + 1) * 3600, arrival(r)
        if at is not None and at >= end:
            want[r[0]] = "corrects" if at - end <= 21600 else "dropped"
    assert {r.seq: r.outcome for r in late.late_rows(graphite(rows)).collect()} == want


def test_late_borders(graphite):
    end = 3600
    rows = [(i, "p", 1.0, i, at) for i, at in enumerate([end - 1, end, end + 21600, end + 21601, 100])]
    assert {r.seq: r.outcome for r in late.late_rows(graphite(rows)).collect()} == {1: "corrects", 2: "corrects", 3: "dropped"}
    got = sorted(late.revisions(graphite(rows)).collect(), key=lambda r: r.arrival_period)
    assert [(r.arrival_period, r.rows, r.n, r.total, r.final) for r in got] == [(0, 2, 2, 2.0, False), (1, 3, 3, 3.0, False), (6, 4, 4, 4.0, True)]


def test_times_of_no_day(graphite):
    """Times beyond all days: messages like others, but on no grid, and no reason to fail."""
    from seriesmill.operators import spikes

    df = graphite([(1, "p", 2.0, 10, 1), (2, "p", 2.0, 9 * 10**18, 1), (3, "p", 2.0, -9 * 10**18, 1), (4, "p", 2.0, 9 * 10**18, 2), (5, "p", 2.0, -5, 1)])
    assert [r["_seq"] for r in messages.deleted(df).collect()] == [4]
    assert sorted(r.Time for r in messages.kept_rows(df).collect()) == [-5, 10]
    assert grid.on_grid(df, RULES).count() == 2 and spikes.implausible(df, []).count() == 0
    assert late.late_rows(df).count() == 2


RULES = [{"rule_no": 1, "regexp": None, "function": "avg", "age": 0, "precision": 60}]


def test_grid_small(graphite):
    rows = [(1, "p", 2.0, 10, 1), (2, "p", 4.0, 70, 1), (3, "p", 8.0, 310, 1), (4, "p", NAN, 200, 1), (5, "q", 1.0, 5, 1)]
    got = {(r.path, r.slot): r for r in grid.on_grid(graphite(rows), RULES).collect()}
    assert [s for p, s in sorted(got) if p == "p"] == [0, 60, 120, 180, 240, 300]
    assert [got["p", s].missing for s in (0, 60, 120, 180, 240, 300)] == [False, False, True, True, True, False]
    assert got["p", 0].value == 2.0 and abs(got["p", 0].coverage - 50 / 60) < 1e-9
    # 2.0 until 70, then 4.0
    assert abs(got["p", 60].value - (2.0 * 10 + 4.0 * 50) / 60) < 1e-9 and got["p", 60].coverage == 1
    # 4.0 is held for one step, so until 130
    assert got["p", 120].value == 4.0 and abs(got["p", 120].coverage - 10 / 60) < 1e-9
    assert got["p", 180].value is None and got["p", 180].coverage == 0


def test_grid_against_brute_force(graphite):
    rows = some_rows(6)
    slots = defaultdict(set)
    for (path, time), r in winners(rows).items():
        if r[2] is not None and r[2] == r[2] and abs(r[2]) != INF:
            slots[path, time // 86400].add(time // 60 * 60)
    want = {(p, s) for (p, _), held in slots.items() for s in range(min(held), max(held), 60) if s not in held}
    got = grid.on_grid(graphite(rows), RULES).where("missing").collect()
    assert {(r.path, r.slot) for r in got} == want and len(got) == len(want)


def test_grid_without_step(graphite):
    assert grid.on_grid(graphite([(1, "p", 2.0, 10, 1)]), [{"rule_no": 1, "regexp": "zzz", "function": "avg", "age": 0, "precision": 60}]).count() == 0
