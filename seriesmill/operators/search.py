"""Finding series in the index and tag tables, and fetching their points."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.paths import reverse_path
from seriesmill.operators.tables import REVERSE, REVERSE_TREE, TREE

_SPECIAL = re.compile(r"[*?\[{]")


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: * and ? within a component, [..] sets, {a,b} alternatives."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^.]*")
        elif c == "?":
            out.append("[^.]")
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            out.append("[" + glob[i + 1 : j].replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = j
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + r"\z"


def _fixed(text: str) -> str:
    m = _SPECIAL.search(text)
    return text[: m.start()] if m else text


def matches(path: Column, glob: str) -> Column:
    """The glob's fixed beginning as a prefix, which reaches the scan, and the rest as a pattern."""
    start = _fixed(glob)
    if start == glob:
        return path == glob
    return (F.startswith(path, F.lit(start)) & path.rlike(glob_pattern(glob))) if start else path.rlike(glob_pattern(glob))


def find(index: DataFrame, glob: str, day: str | None = None) -> DataFrame:
    """Path of the plain series (or with a dot at the end, the nodes) that match; on a day, or ever.

    A glob whose end is fixed for longer than its beginning is looked up in the reversed bands.
    """
    size = glob.rstrip(".").count(".") + 1
    back = ".".join(reversed(glob.split(".")))
    if len(_fixed(back)) > len(_fixed(glob)) and not glob.endswith("."):
        band = size + (REVERSE if day else REVERSE_TREE)
        rows = index.where((F.col("Level") == band) & matches(F.col("Path"), back)).withColumn("Path", reverse_path(F.col("Path")))
    else:
        band = size + (0 if day else TREE)
        rows = index.where((F.col("Level") == band) & matches(F.col("Path"), glob))
    if day:
        rows = rows.where(F.col("Date") == F.lit(day).cast("date"))
    return rows.select("Path").distinct()


def find_tags(tagged: DataFrame, tags: Mapping[str, str], day: str | None = None) -> DataFrame:
    """Path of the series that have all the tags (`__name__` for the name): the first by its Tag1 rows, the others in their Tags."""
    (key, value), *others = tags.items()
    rows = tagged.where(F.col("Tag1") == f"{key}={value}")
    if day:
        rows = rows.where(F.col("Date") == F.lit(day).cast("date"))
    for k, v in others:
        rows = rows.where(F.array_contains("Tags", f"{k}={v}"))
    return rows.select("Path").distinct()


def fetch(points: DataFrame, found: DataFrame, first: int, last: int) -> DataFrame:
    """The points of the found series with Time first..last."""
    return points.where(F.col("Time").between(first, last)).join(found.select("Path"), "Path", "left_semi")
