"""Tables that every task needs: fetched, checked for size, and broadcast."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes that may be sent to every task at once. A larger table is an error, not cut off.
MOST_BYTES = 256 << 20


def fetched(df: DataFrame, what: str, most_bytes: int = MOST_BYTES):
    """The table as Arrow, if it has no more rows than that allows."""
    width = sum({"string": 24, "double": 8, "bigint": 8, "int": 4}.get(k, 64) for _, k in df.dtypes)
    most = most_bytes // width
    out = df.limit(most + 1).toArrow()
    if out.num_rows > most:
        raise ValueError(f"{what}: more than {most} rows of about {width} bytes, which is too much for every task")
    return out


class Lookup:
    """Columns by a whole number, broadcast."""

    def __init__(self, broadcast) -> None:
        self.broadcast = broadcast

    def __getitem__(self, key: int) -> tuple[np.ndarray, ...]:
        at, columns = self.broadcast.value
        a, b = np.searchsorted(at, key, "left"), np.searchsorted(at, key, "right")
        return tuple(c[a:b] for c in columns)


def share(df: DataFrame, key: str, columns: Sequence[str]) -> Lookup:
    t = fetched(df.select(F.col(key).cast("bigint"), *columns), f"table by {key}").sort_by(key)
    return Lookup(df.sparkSession.sparkContext.broadcast((t[key].to_numpy(), tuple(t[c].to_numpy() for c in columns))))
