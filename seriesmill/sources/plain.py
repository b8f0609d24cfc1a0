"""Plain lines `name value timestamp`, parsed in the JVM; works on batches and streams alike.

A line that can't be read isn't lost: it comes out with its error (framing, value, timestamp or tags, the first that
applies) in `error` and null fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.numbers import U32, parse_float
from seriesmill.functions.paths import canonical_tags, squeeze_dots
from seriesmill.functions.templates import Template, apply_templates

_FRAME = r"(?s)^([^ ]+) ([^ ]+) (.*)\z"


def parse(
    lines: DataFrame, line: str = "value", now: Column | int = 0, templates: Sequence[Template] = (), separator: str = ".",
    tags: Sequence[str] = (), compat: bool = False,
) -> DataFrame:
    """Path, Value, Time, Timestamp (now: when received), error, and the columns of lines but the line and those named like these."""
    text = F.regexp_replace(F.col(line), r"\n?\z", "")
    text = F.regexp_replace(text, r"\r\z", "")
    framed = text.rlike(_FRAME)
    name, value, stamp = (F.regexp_extract(text, _FRAME, i) for i in (1, 2, 3))
    received = (now if isinstance(now, Column) else F.lit(now)).cast("bigint")
    v, t = parse_float(value), parse_float(stamp)
    # a time is truncated towards zero and must be an unsigned 32-bit second
    time = F.when(stamp == "-1", received).when((t > -1) & (t < U32), t.cast("bigint"))
    path = squeeze_dots(name)
    if templates:
        path = apply_templates(path, templates, separator, tags, compat)
    path = canonical_tags(path)
    rows = lines.withColumns({"_v": v, "_t": time, "_p": path, "_f": framed})
    error = (
        F.when(~F.coalesce("_f", F.lit(False)), F.lit("framing")).when(F.col("_v").isNull(), F.lit("value"))
        .when(F.col("_t").isNull(), F.lit("timestamp")).when(F.col("_p").isNull(), F.lit("tags"))
    )
    ok = error.isNull()
    made = {"path", "value", "time", "timestamp", "error", line.lower()}
    return rows.select(
        *[F.col(f"`{c}`") for c in lines.columns if c.lower() not in made],
        F.when(ok, F.col("_p")).alias("Path"), F.when(ok, F.col("_v")).alias("Value"), F.when(ok, F.col("_t")).alias("Time"),
        received.alias("Timestamp"), error.alias("error"),
    )


def complete_lines(text: DataFrame, column: str = "value") -> DataFrame:
    """line, and the other columns: the lines of received blocks; empty lines and what follows a block's last line end are left out."""
    kept = [F.col(c) for c in text.columns if c != column]
    parts = F.split(column, "\n", -1)
    return text.select(*kept, F.explode(F.slice(parts, 1, F.size(parts) - 1)).alias("line")).where(F.length("line") > 0)


def format_line(path: Column, value: Column, time: Column) -> Column:
    return F.concat_ws(" ", path, value.cast("string"), time.cast("string"))
