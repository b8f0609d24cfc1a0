"""Queries of the general problems over whole tables: name -> (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.functions.rules import read_rules
from seriesmill.operators import grid, instants, late, messages, spikes, zones
from seriesmill.plans.sql import KEPT, READINGS
from seriesmill.session import table


def p1_grid(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid.on_grid(table(spark, folder, "graphite"), read_rules(table(spark, folder, "rollup_rules")))
    return rows.select("path", "slot", "step", "readings", F.round(F.col("value") + 0.000331234, 2).alias("value"), F.round("coverage", 6).alias("coverage"), "missing")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = grid.on_grid(table(spark, folder, "graphite"), read_rules(table(spark, folder, "rollup_rules")))
    return rows.where("missing").select("path", "slot")


def _instants(spark: SparkSession, folder: str) -> DataFrame:
    names = ("graphite", "prom_sample", "telegraf_metric", "relay_zone")
    return instants.instants(*[table(spark, folder, n) for n in names])


def p2_instants(spark: SparkSession, folder: str) -> DataFrame:
    return _instants(spark, folder).select("src", "rec_id", "utc_s")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _instants(spark, folder).where("changed").select("src", "rec_id", "utc_s")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return messages.deleted(table(spark, folder, "graphite")).select(F.col("_seq").alias("seq"))


def p4_kept(spark: SparkSession, folder: str) -> DataFrame:
    return messages.exactly_once(table(spark, folder, "graphite"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return late.late_rows(table(spark, folder, "graphite"))


def p5_revisions(spark: SparkSession, folder: str) -> DataFrame:
    return late.revisions(table(spark, folder, "graphite")).withColumn("total", F.round("total", 4))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible(table(spark, folder, "graphite"), read_rules(table(spark, folder, "metric_limits"))).select("seq")


def p7_flags(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible(table(spark, folder, "graphite"), read_rules(table(spark, folder, "metric_limits")))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_instants, p4_found, p4_kept, p5_found, p5_revisions, p7_found, p7_flags)
}

_CLOCK = "([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.][0-9]+)?)?(?: ?([AaPp][Mm]))?"
_ZONE = "([Zz]| ?[+-][0-9]{2}(?::?[0-9]{2})?| [A-Za-z]{2}[A-Za-z/_+-]*|[[][A-Za-z]{2}[A-Za-z/_+-]*[]])?"


def _fields(pattern: str, names: str) -> str:
    return f"regexp_extract(t, '^{pattern}$', {names.split()})"


def _utc(zone: str, second: str) -> str:
    """Offset of a zone at an epoch second."""
    return f"(epoch(to_timestamp({second}) AT TIME ZONE {zone})::BIGINT - {second})"


def _scaled(n: str) -> str:
    return f"CASE WHEN {n} < 100000000000 THEN {n} WHEN {n} < 100000000000000 THEN {n} // 1000 WHEN {n} < 100000000000000000 THEN {n} // 1000000 ELSE {n} // 1000000000 END"


#: CTE every: src, rec_id, utc_s and changed of each record that denotes an instant.
INSTANTS = f"""
    tokens AS (
      SELECT metric_id, timestamp AS raw, trim(timestamp, ' ' || chr(9) || chr(10) || chr(13)) AS t, coalesce(received, 9223372036854775807) AS received, zone, day_order
      FROM telegraf_metric LEFT JOIN relay_zone ON relay = tags['relay']),
    numbers AS (
      SELECT metric_id, raw, CASE
        WHEN regexp_full_match(t, '[0-9]{{1,19}}') THEN t::HUGEINT
        WHEN regexp_full_match(t, '[0-9]{{1,18}}[.][0-9]+') THEN split_part(t, '.', 1)::HUGEINT
        WHEN regexp_full_match(t, '[0-9]([.][0-9]+)?[eE][+-]?[0-9]{{1,2}}') AND t::DOUBLE < 1e19 THEN floor(t::DOUBLE)::HUGEINT END AS n FROM tokens),
    matched AS (
      SELECT *, {_fields(f"([0-9]{{4}})[-/]([0-9]{{2}})[-/]([0-9]{{2}})[ Tt]{_CLOCK}{_ZONE}", "y mo d h mi s half tail")} AS a,
        {_fields(f"([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})[Tt]([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})(?:[.][0-9]+)?{_ZONE}", "y mo d h mi s tail")} AS b,
        {_fields(f"([0-9]{{1,2}})[./]([0-9]{{1,2}})[./]([0-9]{{4}}) {_CLOCK}{_ZONE}", "p q y h mi s half tail")} AS c,
        {_fields(f"(?:[A-Za-z]{{3}}, )?([0-9]{{1,2}})[- ]([A-Za-z]{{3}})[- ]([0-9]{{4}}) {_CLOCK}{_ZONE}", "d mon y h mi s half tail")} AS m FROM tokens),
    fields AS (
      SELECT metric_id, raw, received, zone, a.y || b.y || c.y || m.y AS y, a.h || b.h || c.h || m.h AS h, a.mi || b.mi || c.mi || m.mi AS mi,
        coalesce(nullif(a.s || b.s || c.s || m.s, ''), '0') AS s, upper(a.half || c.half || m.half) AS half, trim(a.tail || b.tail || c.tail || m.tail, ' []') AS tail,
        CASE WHEN c.y <> '' THEN CASE day_order WHEN 'mdy' THEN c.p WHEN 'dmy' THEN c.q END
             WHEN m.y <> '' THEN nullif(list_position({list("jan feb mar apr may jun jul aug sep oct nov dec".split())}, lower(m.mon)), 0)::VARCHAR ELSE a.mo || b.mo END AS mo,
        CASE WHEN c.y <> '' THEN CASE day_order WHEN 'mdy' THEN c.q WHEN 'dmy' THEN c.p END ELSE a.d || b.d || m.d END AS d
      FROM matched WHERE a.y || b.y || c.y || m.y <> ''),
    clocks AS (
      SELECT *, CASE WHEN half = '' THEN h::INT WHEN h::INT BETWEEN 1 AND 12 THEN h::INT % 12 + CASE half WHEN 'PM' THEN 12 ELSE 0 END END AS hour,
        try_cast(y || '-' || lpad(mo, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS day FROM fields),
    walls AS (
      SELECT *, (day - DATE '1970-01-01')::BIGINT * 86400 + hour * 3600 + mi::INT * 60 + s::INT AS wall,
        CASE WHEN regexp_matches(tail, '^[+-]') THEN CASE WHEN tail[1] = '-' THEN -1 ELSE 1 END * (tail[2:3]::INT * 3600 + coalesce(try_cast(replace(tail[4:], ':', '') AS INT), 0) * 60)
             ELSE MAP {zones.ABBREVIATIONS}[upper(tail)] END AS fixed,
        CASE WHEN tail = '' THEN zone WHEN tail IN (SELECT zone FROM relay_zone) THEN tail END AS place
      FROM clocks WHERE hour < 24 AND mi::INT < 60 AND s::INT < 60),
    offsets AS (SELECT *, {_utc("place", "(wall - 86400)")} AS o1, {_utc("place", "(wall + 86400)")} AS o2 FROM walls),
    shown AS (SELECT *, {_utc("place", "(wall - o1)")} = o1 AS ok1, {_utc("place", "(wall - o2)")} = o2 AS ok2, least(wall - o1, wall - o2) AS early, greatest(wall - o1, wall - o2) AS late FROM offsets),
    read AS (
      SELECT metric_id, raw, {_scaled("n")} AS utc_s FROM numbers WHERE n > 0
      UNION ALL
      SELECT metric_id, raw, CASE WHEN fixed IS NOT NULL THEN wall - fixed WHEN ok1 AND ok2 THEN CASE WHEN late <= received THEN late ELSE early END
                                  WHEN ok1 THEN wall - o1 WHEN ok2 THEN wall - o2 END FROM shown),
    every AS (
      SELECT 'graphite' AS src, seq AS rec_id, Time - Time % 86400 AS utc_s, Date IS DISTINCT FROM DATE '1970-01-01' + CAST(Time // 86400 AS INTEGER) AS changed
      FROM graphite WHERE Time IS NOT NULL
      UNION ALL SELECT 'prom_sample', sample_id, {_scaled("timestamp")}, NOT (timestamp >= 100000000000 AND timestamp < 100000000000000) FROM prom_sample WHERE timestamp > 0
      UNION ALL SELECT 'telegraf_metric', metric_id, utc_s::BIGINT, NOT regexp_full_match(raw, '[0-9]{{10}}') FROM read WHERE utc_s > 0 AND utc_s <= {instants.LAST_SECOND})
"""

SQL = {
    "p2_instants": f"WITH {INSTANTS} SELECT src, rec_id, utc_s FROM every",
    "p2_found": f"WITH {INSTANTS} SELECT src, rec_id, utc_s FROM every WHERE changed",
    "p1_found": f"""
        WITH {READINGS},
        slots AS (SELECT DISTINCT path, step, Time // 86400 AS day, Time - Time % step AS slot FROM stepped),
        gaps AS (SELECT path, step, slot, lead(slot) OVER (PARTITION BY path, day ORDER BY slot) AS upto FROM slots)
        SELECT path, unnest(generate_series(slot + step, upto - step, step)) AS slot FROM gaps WHERE upto > slot + step
    """,
    "p1_grid": f"""
        WITH {READINGS},
        pieces AS (SELECT path, step, Time // 86400 AS day, Time, Value, lead(Time) OVER (PARTITION BY path, Time // 86400 ORDER BY Time) AS nxt FROM stepped),
        ends AS (SELECT *, least(coalesce(nxt, Time + step), Time + step, (day + 1) * 86400) AS upto FROM pieces),
        cells AS (SELECT *, unnest(generate_series(Time - Time % step, coalesce(nxt - 1, Time) - coalesce(nxt - 1, Time) % step, step)) AS slot FROM ends),
        cut AS (SELECT *, greatest(0, least(upto, slot + step) - greatest(Time, slot)) AS held FROM cells)
        SELECT path, slot, any_value(step) AS step, CAST(count(*) FILTER (Time >= slot) AS BIGINT) AS readings,
               round(sum(Value * held) FILTER (held > 0) / sum(held) FILTER (held > 0) + 0.000331234, 2) AS value,
               round(sum(held) / any_value(step), 6) AS coverage, count(*) FILTER (Time >= slot) = 0 AS missing
        FROM cut GROUP BY path, slot
    """,
    "p4_found": f"WITH {KEPT} SELECT seq FROM ranked WHERE nth > 1",
    "p4_kept": f"""
        WITH {KEPT}
        SELECT seq, chunk, Path, Value, Time, Date, Timestamp FROM ranked WHERE nth = 1
        UNION ALL SELECT seq, chunk, Path, Value, Time, Date, Timestamp FROM graphite WHERE Path IS NULL OR Time IS NULL
    """,
    "p5_found": f"""
        WITH {KEPT}
        SELECT seq, CASE WHEN arrival - (Time // 3600 + 1) * 3600 <= 21600 THEN 'corrects' ELSE 'dropped' END AS outcome
        FROM ranked WHERE nth = 1 AND arrival >= (Time // 3600 + 1) * 3600
    """,
    "p5_revisions": f"""
        WITH {KEPT},
        placed AS (
          SELECT cpath AS path, Time // 3600 * 3600 AS hour, arrival - (Time // 3600 + 1) * 3600 AS after,
                 CASE WHEN isfinite(Value) THEN Value END AS good FROM ranked WHERE nth = 1),
        periods AS (SELECT *, CASE WHEN after >= 0 THEN greatest(1, CAST(ceil(after / 3600) AS BIGINT)) ELSE 0 END AS arrival_period FROM placed),
        cells AS (
          SELECT path, hour, arrival_period, count(*) AS rows_new, count(good) AS n, sum(good) AS total, min(good) AS lowest, max(good) AS highest
          FROM periods WHERE arrival_period <= 6 GROUP BY ALL)
        SELECT a.path, a.hour, a.arrival_period, any_value(a.rows_new) AS rows_new, CAST(sum(b.rows_new) AS BIGINT) AS rows, CAST(sum(b.n) AS BIGINT) AS n,
               round(sum(b.total), 4) AS total, min(b.lowest) AS lowest, max(b.highest) AS highest,
               NOT EXISTS (FROM cells c WHERE c.path = a.path AND c.hour = a.hour AND c.arrival_period > a.arrival_period) AS final
        FROM cells a JOIN cells b ON a.path = b.path AND a.hour = b.hour AND b.arrival_period <= a.arrival_period
        GROUP BY ALL
    """,
}
