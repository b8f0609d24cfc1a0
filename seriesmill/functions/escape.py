"""Percent-encoding of metric names and tags, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a name keeps although url_encode escapes them.
NAME_KEEPS = "$&+,/:;=@"


def query_escape(c: Column) -> Column:
    """Keeps A-Z a-z 0-9 - _ . ~; a space becomes +, every other byte %XX. Null stays null."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def path_escape(c: Column) -> Column:
    """Like query_escape, but keeps NAME_KEEPS as well and writes a space as %20. Null stays null."""
    out = F.replace(query_escape(c), F.lit("+"), F.lit("%20"))
    for ch in NAME_KEEPS:
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return out


def unescape(c: Column) -> Column:
    """Lenient decoding: %XX is a byte, + a space; a malformed % stays with its next two characters.

    Runs of well-formed escapes are decoded together, so that multi-byte characters come out whole.
    """
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)((?:%[0-9A-Fa-f]{2})+|%.{0,2}|[^%]+)"), F.lit(1))
    decoded = F.transform(
        tokens,
        lambda t: F.when(t.rlike(r"^(?:%[0-9A-Fa-f]{2})+\z"), F.url_decode(t))
        .when(F.startswith(t, F.lit("%")), t)
        .otherwise(F.replace(t, F.lit("+"), F.lit(" "))),
    )
    return F.array_join(decoded, "")
