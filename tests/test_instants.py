"""Instants: each token against an independent reading of it, one by one."""

import datetime as dt
import re
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from seriesmill.operators import instants, zones

UTC = dt.timezone.utc


def local(text, zone, latest=10**12):
    """Reads a wall-clock text the slow way: which instants show it?"""
    want = dt.datetime.fromisoformat(text)
    base = int(want.replace(tzinfo=UTC).timestamp())
    hits = sorted({base - off for off in range(-14 * 3600, 15 * 3600, 900) if dt.datetime.fromtimestamp(base - off, ZoneInfo(zone)).replace(tzinfo=None) == want})
    return max([h for h in hits if h <= latest], default=hits[0] if hits else None)


CASES = [
    # token, zone, order, received, instant
    ("1710047075", None, None, 0, 1710047075),
    ("1710047308508", None, None, 0, 1710047308),
    ("1710051753250198247", None, None, 0, 1710051753),
    ("1710050533208724", None, None, 0, 1710050533),
    ("1711843296.0", None, None, 0, 1711843296),
    ("1.710054311e9", None, None, 0, 1710054311),
    ("1.710052726E+09", None, None, 0, 1710052726),
    ("1.7E-3", None, None, 0, None),
    ("2024-03-10T05:14:57Z", None, None, 0, 1710047697),
    ("20240310T055241Z", None, None, 0, 1710049961),
    ("2024-03-31T00:22:39+01:00", None, None, 0, 1711840959),
    ("2024-03-10T01:13:28-0500", None, None, 0, 1710051208),
    ("2024-03-31 01:08:54+01", None, None, 0, 1711843734),
    ("Sat, 26 Oct 2024 23:59:20 GMT", None, None, 0, 1729987160),
    ("Sun, 7 Apr 2024 01:09:45 +1030", None, None, 0, 1712414385),
    ("2024-03-10 03:03:19 EDT", "UTC", None, 0, 1710054199),
    ("2024-03-31 00:00:22 CET", None, None, 0, 1711839622),
    ("31-Mar-2024 00:17:11", "Europe/Berlin", "dmy", 10**12, 1711840631),
    ("03/10/2024 12:06:11 AM", "America/New_York", "mdy", 10**12, 1710047171),
    ("11/10/2024 06:51:53 PM", "America/New_York", "mdy", 10**12, 1731282713),
    ("01.11.2024 01:19:19", "Asia/Kathmandu", "dmy", 10**12, 1730403259),
    ("01.11.2024 01:19:19", "Asia/Kathmandu", None, 10**12, None),
    ("2024-10-27T02:30:00[Europe/Berlin]", None, None, 10**12, 1729992600),
    ("2024-10-27T02:30:00[Europe/Berlin]", None, None, 1729990000, 1729989000),
    ("2024-10-27 02:30:00", "Europe/Berlin", None, 1729992599, 1729989000),
    ("2024-03-31 02:30:00", "Europe/Berlin", None, 10**12, None),
    ("2024-03-10 02:30:00 America/New_York", None, None, 10**12, None),
    ("2024-10-26 06:46:48", None, None, 10**12, None),
    ("2024-10-26 06:46:48.999", "UTC", None, 10**12, 1729925208),
    ("2024-02-30 00:00:00Z", None, None, 0, None),
    ("2024-02-29T00:00:00Z", None, None, 0, 1709164800),
    ("2024-13-45T99:00:00Z", None, None, 0, None),
    ("0000-00-00 00:00:00", "UTC", None, 0, None),
    ("2024-10-27T02:30:00[No/Where]", "UTC", None, 10**12, None),
    ("99999999999999999999", None, None, 0, None),
    ("0", None, None, 0, None), ("-1", None, None, 0, None), ("", None, None, 0, None), ("now", None, None, 0, None), ("n/a", None, None, 0, None), ("é", None, None, 0, None),
    ("x" * 100000, None, None, 0, None),
]


def test_cases():
    tokens = [c[0] for c in CASES]
    masks = [re.sub("[A-Za-z]", "A", re.sub("[0-9]", "9", t)) for t in tokens]
    text = lambda k: np.array([c[k] or "" for c in CASES], object)
    utc, found = instants.parse_tokens(tokens, masks, text(1), text(2), np.array([c[3] for c in CASES], np.int64))
    got = [int(u) if f else None for u, f in zip(utc, found, strict=True)]
    assert {t: (g, c[4]) for t, g, c in zip(tokens, got, CASES, strict=True) if g != c[4]} == {}


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Adelaide", "America/Sao_Paulo", "Asia/Kathmandu", "Asia/Kolkata", "UTC", "Pacific/Apia"])
def test_local_times(zone):
    table = zones.transitions(zone)
    for day in ("2024-03-10", "2024-03-31", "2024-10-27", "2024-11-03", "2025-04-06", "2024-10-06", "2024-07-01"):
        for clock in ("00:30:00", "01:30:00", "02:00:00", "02:30:00", "03:00:00"):
            base = int(dt.datetime.fromisoformat(f"{day}T{clock}+00:00").timestamp())
            for latest in (10**11, local(f"{day} {clock}", zone, 10**11) or 0):
                utc, ok = zones.local_to_utc(table, np.array([base]), np.array([latest - (latest < 10**11)]))
                want = local(f"{day} {clock}", zone, latest - (latest < 10**11))
                assert (int(utc[0]) if ok[0] else None) == want


def test_masks_are_compiled_once():
    instants.compile_mask.cache_clear()
    for _ in range(3):
        instants.parse_tokens(["2024-03-10T05:14:57Z", "17"], ["9999-99-99A99:99:99A", "99"], *[np.array(["", ""], object)] * 2, np.zeros(2, np.int64))
    assert instants.compile_mask.cache_info().misses == 2


def test_version_of_zone_data(monkeypatch, tmp_path):
    """Without the package the system's files have a digest; without any there is no version."""
    import builtins

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ImportError) if name == "tzdata" else real(name, *a, **k))
    (tmp_path / "Zone").write_bytes(b"TZif1")
    seen = set()
    for content in (b"TZif1", b"TZif2"):
        (tmp_path / "Zone").write_bytes(content)
        monkeypatch.setattr(zones.zoneinfo, "TZPATH", (str(tmp_path),))
        zones.version.cache_clear()
        seen.add(zones.version())
    assert len(seen) == 2 and all(v.startswith("system-") for v in seen)
    monkeypatch.setattr(zones.zoneinfo, "TZPATH", (str(tmp_path / "none"),))
    zones.version.cache_clear()
    with pytest.raises(RuntimeError):
        zones.version()
    zones.version.cache_clear()


def test_tables_and_nulls(spark):
    metrics = spark.createDataFrame(
        [(1, " 1710047075", {"relay": "r"}, 10**10), (2, "2024-03-10 00:00:00", {"relay": "r"}, None), (3, None, None, None), (4, "1710047075", {}, 0), (5, "2024-03-10 00:00:00", {"relay": "other"}, 1), (6, "\t\n", None, 1)],
        "metric_id bigint, timestamp string, tags map<string,string>, received bigint",
    )
    relays = spark.createDataFrame([("r", "Asia/Kolkata", "dmy")], "relay string, zone string, day_order string")
    samples = spark.createDataFrame([(1, 1710047075), (2, 1710047075000), (3, None), (4, 0), (5, -62135596800000), (6, 1710047075123456), (7, 1710047075123456789)], "sample_id bigint, timestamp bigint")
    points = spark.createDataFrame([(1, 86399, "1970-01-01"), (2, 86400, "1970-01-01"), (3, 5, None), (4, None, "1970-01-01")], "seq bigint, Time bigint, Date string").selectExpr("seq", "Time", "cast(Date as date) Date")
    rows = {(r.src, r.rec_id): (r.utc_s, r.changed) for r in instants.instants(points, samples, metrics, relays).collect()}
    assert rows == {
        ("graphite", 1): (0, False), ("graphite", 2): (86400, True), ("graphite", 3): (0, True),
        ("prom_sample", 1): (1710047075, True), ("prom_sample", 2): (1710047075, False), ("prom_sample", 6): (1710047075, True), ("prom_sample", 7): (1710047075, True),
        ("telegraf_metric", 1): (1710047075, True), ("telegraf_metric", 2): (1710009000, True), ("telegraf_metric", 4): (1710047075, False),
    }
    assert instants.instants(*[t.where("false") for t in (points, samples, metrics, relays)]).count() == 0
