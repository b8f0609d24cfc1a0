"""Which points are dropped, and why."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.numbers import wrap_u32
from seriesmill.functions.paths import is_tagged, reverse_path


def drop_reason(path: Column, time: Column, now: Column, future: int = 0, past: int = 0, longest: int = 0) -> Column:
    """`future`, `past` or `long`, the first that applies, else null. 0 switches a rule off. Times are unsigned 32-bit seconds.

    now: when the point was received. longest counts the bytes of the canonical path.
    """
    never = F.lit(False)
    return (
        F.when((time > wrap_u32(now + future)) if future else never, F.lit("future"))
        .when((now > wrap_u32(time + past)) if past else never, F.lit("past"))
        .when((F.octet_length(path) > longest) if longest else never, F.lit("long"))
    )


def split_drops(points: DataFrame, **rules: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with `reason`). points: Path, Time, Timestamp (when received)."""
    marked = points.withColumn("reason", drop_reason(F.col("Path"), F.col("Time"), F.col("Timestamp"), **rules))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def recent_drops(dropped: DataFrame, order: str, receiver: str, most: int = 1000) -> DataFrame:
    """line: the last `most` drops (a report), as receiver/path/time/value, sorted."""
    line = F.concat_ws("/", F.lit(receiver), "Path", "Time", "Value").alias("line")
    return dropped.orderBy(F.col(order).desc()).limit(most).select(line).orderBy("line")


def blacklisted(path: Column, patterns: Sequence[str], reversed_path: bool = False) -> Column:
    """Plain paths that match a pattern component by component; only a whole component may be *."""
    if not patterns:
        return F.lit(False)
    quote = lambda p: "[.]".join("[^.]*" if c == "*" else re.escape(c) for c in p.split("."))
    one = "^(?:" + "|".join(quote(p) for p in patterns) + r")\z"
    return ~is_tagged(path) & (reverse_path(path) if reversed_path else path).rlike(one)


def without_blacklisted(points: DataFrame, patterns: Sequence[str], reversed_path: bool = False) -> DataFrame:
    return points.where(~blacklisted(F.col("Path"), patterns, reversed_path))
