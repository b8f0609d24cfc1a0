"""Paths: plain `a.b.c` and tagged `name?k=v&...`, their wire forms and parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmill.functions.escape import path_escape, query_escape, unescape


def squeeze_dots(c: Column) -> Column:
    """Each run of dots becomes one dot."""
    return F.when(F.contains(c, F.lit("..")), F.regexp_replace(c, r"\.{2,}", ".")).otherwise(c)


def is_tagged(c: Column) -> Column:
    return F.contains(c, F.lit("?"))


def path_level(c: Column) -> Column:
    """Number of dot-separated components."""
    return F.size(F.split(c, r"\.", -1)).cast("bigint")


def reverse_path(c: Column) -> Column:
    """Components in reverse order; empty components are kept."""
    return F.array_join(F.reverse(F.split(c, r"\.", -1)), ".")


def ancestor_prefixes(c: Column) -> Column:
    """array<struct<Level, Path>> of `a.`, `a.b.`, ... for every proper ancestor; empty for one component."""
    parts = F.split(c, r"\.", -1)
    n = F.size(parts)
    none = F.array().cast("array<struct<Level:bigint,Path:string>>")
    some = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.struct(
            i.cast("bigint").alias("Level"), F.concat(F.array_join(F.slice(parts, 1, i), "."), F.lit(".")).alias("Path")
        ),
    )
    return F.when(n > 1, some).otherwise(none)


def canonical_tags(c: Column) -> Column:
    """`name;k=v;...` to `name?k=v&...`: keys sorted by bytes, the last of equal keys wins, all parts escaped.

    A path without `;` is returned as it is; one whose tags can't be read gives null.
    """
    parts = F.split(c, ";", -1)
    name, tags = F.get(parts, F.lit(0)), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    pairs = F.transform(
        tags,
        lambda t, i: F.struct(
            F.substring_index(t, "=", 1).alias("k"), i.alias("i"), F.substring(t, F.instr(t, "=") + 1, F.length(t)).alias("v")
        ),
    )
    last = F.filter(pairs, lambda x: ~F.exists(pairs, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    query = F.array_join(
        F.transform(F.array_sort(last), lambda x: F.concat(query_escape(x["k"]), F.lit("="), query_escape(x["v"]))), "&"
    )
    valid = (name != "") & F.forall(tags, lambda t: F.instr(t, "=") > 1)
    return F.when(~F.contains(c, F.lit(";")), c).when(valid, F.concat(path_escape(name), F.lit("?"), query))


def canonical_path(c: Column) -> Column:
    """The one name of a series: dots squeezed; wire form (`;` and no `?`) turned into `name?k=v&...`.

    Defined results: null stays null; a wire form that can't be read stays as squeezed; an empty path stays empty.
    """
    s = squeeze_dots(c)
    return F.when(F.contains(s, F.lit(";")) & ~is_tagged(s), F.coalesce(canonical_tags(s), s)).otherwise(s)


def tag_list(c: Column) -> Column:
    """`n?k=v&...` to [`__name__=n`, `k=v`, ...], unescaped; stops at the first piece without `=`.

    Null for a path without `?` or with an empty name before it.
    """
    name = F.substring_index(c, "?", 1)
    rest = F.substring(c, F.length(name) + 2, F.length(c))
    pieces = F.split(rest, "&", -1)
    first_bad = F.get(
        F.filter(F.transform(pieces, lambda p, i: F.when(~F.contains(p, F.lit("=")), i)), lambda i: i.isNotNull()), F.lit(0)
    )
    good = F.slice(pieces, F.lit(1), F.coalesce(first_bad, F.size(pieces)))
    return F.when(
        is_tagged(c) & (name != ""),
        F.concat(F.array(F.concat(F.lit("__name__="), unescape(name))), F.transform(good, unescape)),
    )


def tag_map(c: Column) -> Column:
    """The tags of tag_list as a map, __name__ among them; of equal keys the last one wins."""
    pairs = F.transform(
        tag_list(c), lambda t, i: F.struct(F.substring_index(t, "=", 1).alias("k"), i.alias("i"), F.substring(t, F.instr(t, "=") + 1, F.length(t)).alias("v"))
    )
    last = F.filter(pairs, lambda x: ~F.exists(pairs, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))
