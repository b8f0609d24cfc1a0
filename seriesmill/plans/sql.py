"""Pieces of SQL for the oracle: escapes, canonical paths, kept rows."""

from __future__ import annotations


def query_escape(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def path_escape(x: str) -> str:
    out = f"url_encode({x})"
    for ch in "$&+,/:;=@":
        out = f"replace({out}, '%{ord(ch):02X}', '{ch}')"
    return out


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '[.]{{2,}}', '.', 'g')"


def reverse(x: str) -> str:
    return f"array_to_string(list_reverse(string_split({x}, '.')), '.')"


def canonical_tags(x: str) -> str:
    """Of a wire form; null where it can't be read."""
    tags = f"string_split({x}, ';')[2:]"
    key = "split_part({0}, '=', 1)"
    last = f"list_filter({tags}, lambda t, i: NOT list_contains(list_transform(({tags})[i + 1:], lambda q: {key.format('q')}), {key.format('t')}))"
    ordered = f"list_sort(list_transform({last}, lambda t: {key.format('t')} || chr(1) || substr(t, instr(t, '=') + 1)))"
    k, v = query_escape("split_part(t, chr(1), 1)"), query_escape("split_part(t, chr(1), 2)")
    made = f"{path_escape(f'split_part({x}, chr(59), 1)')} || '?' || array_to_string(list_transform({ordered}, lambda t: {k} || '=' || {v}), '&')"
    return f"CASE WHEN NOT starts_with({x}, ';') AND len(list_filter({tags}, lambda t: instr(t, '=') < 2)) = 0 THEN {made} END"


def canonical(x: str) -> str:
    """x: a column that holds the squeezed path."""
    return f"CASE WHEN contains({x}, ';') AND NOT contains({x}, '?') THEN coalesce({canonical_tags(x)}, {x}) ELSE {x} END"


#: CTE ranked: the rows that belong to a message, with cpath, arrival and nth (1: the kept row).
KEPT = f"""
    squeezed AS (
      SELECT *, {squeeze('Path')} AS sq,
             CASE WHEN Timestamp <> 0 THEN Timestamp ELSE try_cast(split_part(chunk, '.', 2) AS BIGINT) // 1000000000 END AS arrival
      FROM graphite WHERE Path IS NOT NULL AND Time IS NOT NULL),
    named AS (SELECT *, {canonical('sq')} AS cpath FROM squeezed),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cpath, Time ORDER BY arrival NULLS LAST, seq) AS nth FROM named)
"""

#: CTE stepped: path, step, Time and Value of each reading.
READINGS = f"""{KEPT},
    good AS (SELECT cpath AS path, Time, Value FROM ranked WHERE nth = 1 AND isfinite(Value)),
    steps AS (
      SELECT path, arg_min(r.precision, r.rule_no)::BIGINT AS step
      FROM (SELECT DISTINCT path FROM good) g, rollup_rules r
      WHERE r.age = 0 AND (r.regexp IS NULL OR regexp_matches(g.path, r.regexp)) GROUP BY path),
    stepped AS (SELECT path, step, Time, Value FROM good JOIN steps USING (path))
"""
