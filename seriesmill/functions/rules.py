"""Small rule tables (first match by rule_no), compiled into one CASE expression over the path."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: A rule table is configuration. More rules than this are refused, since the expression grows with them.
MOST_RULES = 1000


def read_rules(df: DataFrame) -> list[Row]:
    """The rules in order. They are fetched to the driver; a table above MOST_RULES is an error, not cut off."""
    rows = df.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted(rows, key=lambda r: r["rule_no"])


def first_match(path: Column, rules: Iterable[Row], value: str, kind: str) -> Column:
    """`value` of the first rule whose regexp is found in the path; an empty or null regexp matches every path."""
    out: Column | None = None
    for r in rules:
        hit = path.rlike(r["regexp"]) if r["regexp"] else F.lit(True)
        v = F.lit(r[value]).cast(kind)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return F.lit(None).cast(kind) if out is None else out


def series_step(path: Column, rules: Iterable[Row]) -> Column:
    """Precision in seconds of the first rule of age 0 that matches the canonical path; null if none does."""
    return first_match(path, [r for r in rules if r["age"] == 0], "precision", "bigint")
