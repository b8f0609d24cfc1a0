"""Zone transition tables: for each zone the UTC seconds at which its offset changes, from one version of the zone data."""

from __future__ import annotations

import datetime as dt
import hashlib
import zoneinfo
from functools import lru_cache
from pathlib import Path
from zoneinfo import ZoneInfo

import numpy as np

#: Years that the tables cover; an instant outside has the offset of the nearest covered one.
FROM_YEAR, TO_YEAR = 1970, 2100
#: Zone abbreviations and their offsets in seconds. The first line is that of RFC 5322 (4.3), which settles names
#: that elsewhere mean other zones as well; the others mean one offset. Names left out (BST, IST, ...) denote no zone.
ABBREVIATIONS = {
    "UT": 0, "GMT": 0, "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000, "MST": -25200, "MDT": -21600, "PST": -28800, "PDT": -25200,
    "Z": 0, "UTC": 0, "WET": 0, "WEST": 3600, "CET": 3600, "CEST": 7200, "EET": 7200, "EEST": 10800, "MSK": 10800, "NPT": 20700, "JST": 32400,
    "ACST": 34200, "AEST": 36000, "ACDT": 37800, "AEDT": 39600, "BRT": -10800,
}


@lru_cache(maxsize=1)
def version() -> str:
    """Version of the zone data that this process would use: its release, or a digest of the system's files."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        pass
    for folder in map(Path, zoneinfo.TZPATH):
        files = sorted(p for p in folder.rglob("*") if p.is_file() and p.open("rb").read(4) == b"TZif") if folder.is_dir() else []
        if files:
            digest = hashlib.sha256()
            for p in files:
                digest.update(str(p.relative_to(folder)).encode() + b"\0" + p.read_bytes())
            return f"system-{digest.hexdigest()[:16]}"
    raise RuntimeError("no zone data: neither the tzdata package nor the system has any")


@lru_cache(maxsize=1024)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(starts, offsets): offsets[i] holds from starts[i] on; starts[0] is the least integer. None: no such zone."""
    try:
        z = ZoneInfo(zone)
    except Exception:  # unknown names raise several kinds
        return None
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)

    def offset(t: int) -> int:
        return int((epoch + dt.timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())

    step, end = 14 * 86400, int((dt.datetime(TO_YEAR, 1, 1, tzinfo=dt.timezone.utc) - epoch).total_seconds())
    starts, offsets = [np.iinfo(np.int64).min], [offset(0)]
    for t in range(0, end, step):
        if (after := offset(t + step)) != offsets[-1]:
            lo, hi = t, t + step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if offset(mid) != offsets[-1] else (mid, hi)
            starts.append(hi)
            offsets.append(after)
    return np.array(starts, np.int64), np.array(offsets, np.int64)


def offset_at(table: tuple[np.ndarray, np.ndarray], utc: np.ndarray) -> np.ndarray:
    starts, offsets = table
    return offsets[np.searchsorted(starts, utc, side="right") - 1]


def local_to_utc(table: tuple[np.ndarray, np.ndarray], local: np.ndarray, latest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(utc, found) of wall-clock seconds. Of two instants, the later one that is not after `latest`, else the earlier.

    A wall-clock time that the zone skips denotes no instant.
    """
    before, after = offset_at(table, local - 86400), offset_at(table, local + 86400)
    first, second = local - before, local - after
    ok1, ok2 = offset_at(table, first) == before, offset_at(table, second) == after
    early, late = np.minimum(first, second), np.maximum(first, second)
    both = np.where(late <= latest, late, early)
    return np.where(ok1 & ok2, both, np.where(ok1, first, second)), ok1 | ok2
