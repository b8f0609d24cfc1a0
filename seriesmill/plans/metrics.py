"""Queries of the engine's own operators over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.functions import escape, numbers, paths
from seriesmill.functions.rules import read_rules
from seriesmill.functions.templates import Template, apply_templates
from seriesmill.operators import filters, search, storage, tables
from seriesmill.plans import sql as S
from seriesmill.session import shared_folder, table
from seriesmill.sources import binary, plain, telegraf, union
from seriesmill.streaming import fanout, metrics

NOW, VERSION, TTL = 1706745600, 1706745600, 43200
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- inputs: metric lines made of events, and the points as received

TIME = "CAST(floor(epoch(ts)) AS BIGINT)"


def _lines(spark: SparkSession, folder: str, tagged: bool = False) -> DataFrame:
    e = table(spark, folder, "events")
    time = F.unix_timestamp("ts").cast("string")
    if tagged:
        name = F.concat(F.col("event_type"), F.lit(";user="), F.col("user_id"), F.lit(";app=shop:a;user="), F.col("user_id") + 1)
    else:
        name = F.concat(F.lit("events.."), F.col("event_type"), F.lit(".u"), F.col("user_id"))
    return e.select("event_id", F.concat_ws(" ", name, F.col("value").cast("string"), time).alias("value"))


def _event_points(spark: SparkSession, folder: str, tagged: bool = False) -> DataFrame:
    rows = plain.parse(_lines(spark, folder, tagged), "value", NOW)
    return rows.select("event_id", "Path", "Value", "Time", numbers.utc_day(F.col("Time")).alias("Date"), "Timestamp")


def _points(spark: SparkSession, folder: str) -> DataFrame:
    """The received points with canonical paths, those without path or time left out."""
    g = table(spark, folder, "graphite").where("Path IS NOT NULL AND Time IS NOT NULL")
    return g.select("seq", paths.canonical_path(F.col("Path")).alias("Path"), "Value", "Time", numbers.utc_day(F.col("Time")).alias("Date"), "Timestamp")


EVENTS = f"""
    e AS (SELECT event_id, 'events.' || event_type || '.u' || user_id AS Path, value AS Value, {TIME} AS Time,
                 CAST(ts AS DATE) AS Date, {NOW}::BIGINT AS Timestamp FROM events),
    t AS (SELECT event_id, event_type || '?app=shop%3Aa&user=' || (user_id + 1) AS Path, value AS Value, {TIME} AS Time,
                 CAST(ts AS DATE) AS Date, {NOW}::BIGINT AS Timestamp, event_type, user_id FROM events)
"""
POINTS = f"""
    squeezed AS (SELECT *, {S.squeeze('Path')} AS sq FROM graphite WHERE Path IS NOT NULL AND Time IS NOT NULL),
    p AS (SELECT seq, {S.canonical('sq')} AS Path, Value, Time, DATE '1970-01-01' + CAST(Time // 86400 AS INTEGER) AS Date, Timestamp FROM squeezed)
"""


# --- lines


@query(f"WITH {EVENTS} SELECT event_id, Path, Value, Time, Date, Timestamp FROM e")
def plain_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _event_points(spark, folder)


@query(f"WITH {EVENTS} SELECT event_id, Path, Value, Time, Date, Timestamp FROM t")
def plain_parse_tagged(spark: SparkSession, folder: str) -> DataFrame:
    return _event_points(spark, folder, True)


#: By event_id % 8: what becomes of a line `n 1.5 100`, and the error it should give.
SPOILT = ("n  1.5 100", "n 1.5", "n 1.5x 100", "n NaN 100", "n 1e400 100", "n 1.5 -5", "n;k 1.5 100", "n 0x1p3 -1\r")
ERRORS = ("framing", "framing", "value", "value", "value", "timestamp", "tags", None)


@query(
    "SELECT event_id, CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ERRORS) if e) + " END AS error, "
    f"CASE WHEN event_id % 8 = 7 THEN 8.0::DOUBLE END AS Value, CASE WHEN event_id % 8 = 7 THEN {NOW}::BIGINT END AS Time FROM events"
)
def plain_parse_errors(spark: SparkSession, folder: str) -> DataFrame:
    line = F.element_at(F.array(*[F.lit(s) for s in SPOILT]), (F.col("event_id") % 8 + 1).cast("int"))
    rows = plain.parse(table(spark, folder, "events").select("event_id", line.alias("value")), "value", NOW)
    return rows.select("event_id", "error", "Value", "Time")


@query("""
    SELECT user_id, event_type || '.' || event_id AS Path, value AS Value, CAST(floor(epoch(ts)) AS BIGINT) AS Time
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back > 1
""")
def framing(spark: SparkSession, folder: str) -> DataFrame:
    """Received blocks, one for each user, whose last line is unfinished."""
    line = F.concat_ws(" ", F.concat_ws(".", "event_type", "event_id"), F.col("value").cast("string"), F.unix_timestamp("ts").cast("string"))
    per = table(spark, folder, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x"))
    blocks = per.select("user_id", F.array_join(F.transform("x", lambda x: x["line"]), "\r\n").alias("block"))
    return plain.parse(plain.complete_lines(blocks, "block"), "line", NOW).select("user_id", "Path", "Value", "Time")


@query(f"SELECT seq, {S.squeeze('Path')} AS path FROM graphite")
def squeeze_dots(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graphite").select("seq", paths.squeeze_dots(F.col("Path")).alias("path"))


@query("SELECT seq, CAST(len(string_split(Path, '.')) AS BIGINT) AS level FROM graphite")
def path_level(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graphite").select("seq", paths.path_level(F.col("Path")).alias("level"))


@query(f"SELECT seq, {S.reverse('Path')} AS path FROM graphite")
def reverse_path(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graphite").select("seq", paths.reverse_path(F.col("Path")).alias("path"))


@query("""
    WITH d AS (SELECT DISTINCT Path, string_split(Path, '.') AS a FROM graphite_index WHERE Path IS NOT NULL),
    n AS (SELECT a, unnest(generate_series(1, len(a) - 1)) AS level FROM d)
    SELECT DISTINCT CAST(level AS BIGINT) AS level, array_to_string(a[1:level], '.') || '.' AS path FROM n
""")
def path_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "graphite_index").select("Path").where("Path IS NOT NULL").distinct()
    up = rows.select(F.explode(paths.ancestor_prefixes(F.col("Path"))).alias("a"))
    return up.select(F.col("a.Level").alias("level"), F.col("a.Path").alias("path")).distinct()


@query(f"SELECT metric_id, {S.query_escape('name')} AS name, {S.query_escape('fields')} AS fields FROM telegraf_metric")
def query_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "telegraf_metric").select("metric_id", *[escape.query_escape(F.col(c)).alias(c) for c in ("name", "fields")])


@query(f"SELECT metric_id, {S.path_escape('name')} AS name, {S.path_escape('fields')} AS fields FROM telegraf_metric")
def path_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "telegraf_metric").select("metric_id", *[escape.path_escape(F.col(c)).alias(c) for c in ("name", "fields")])


#: By event_id % 12: an escaped text, and what it stands for.
ESCAPED = (
    ("cpu%20idle", "cpu idle"), ("%", "%"), ("%a", "%a"), ("%zz", "%zz"), ("%E4%B8%AD", "中"), ("50%25+more", "50% more"), ("%4", "%4"), ("%%41", "%%41"), ("a%2Fb%2fc", "a/b/c"),
    ("%D0%B8x%C3%A9", "иxé"), ("+%2B+", " + "), ("100%", "100%"),
)


@query(
    "SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(ESCAPED)) + " END || '.' || event_type AS text, "
    "m.fields FROM events LEFT JOIN (SELECT metric_id, fields FROM telegraf_metric) m ON metric_id = event_id"
)
def unescape(spark: SparkSession, folder: str) -> DataFrame:
    """Escapes, well formed and not; and texts that are escaped and brought back."""
    text = F.concat(F.element_at(F.array(*[F.lit(e) for e, _ in ESCAPED]), (F.col("event_id") % 12 + 1).cast("int")), F.lit("."), "event_type")
    fields = table(spark, folder, "telegraf_metric").select("metric_id", escape.unescape(escape.query_escape(F.col("fields"))).alias("fields"))
    rows = table(spark, folder, "events").select("event_id", escape.unescape(text).alias("text"))
    return rows.join(fields, F.col("event_id") == F.col("metric_id"), "left").select("event_id", "text", "fields")


@query(f"WITH {POINTS} SELECT seq, Path AS path FROM p")
def tag_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return _points(spark, folder).select("seq", F.col("Path").alias("path"))


TEMPLATES = [Template.parse(t) for t in ("events.* .kind.measurement* app=shop", "lab.* .host.measurement.core.measurement", ".measurement*")]


@query(f"""
    WITH named AS (
      SELECT event_id, event_id % 4 AS k, event_type AS kind, 'u' || user_id AS who FROM events)
    SELECT event_id, CASE k
      WHEN 0 THEN who || '_x?app=shop&dc=one&kind=' || kind
      WHEN 1 THEN 'load_' || kind || '?core=c7&dc=one&host=' || who
      WHEN 2 THEN kind || '_' || who || '_x?dc=one' ELSE kind END AS path FROM named
""")
def template_tags(spark: SparkSession, folder: str) -> DataFrame:
    """A name for each of the three templates, and one that none matches."""
    kind, who, dot = F.col("event_type"), F.concat(F.lit("u"), "user_id"), F.lit(".")
    forms = F.array(
        F.concat(F.lit("events."), kind, dot, who, F.lit(".x")), F.concat(F.lit("lab."), who, F.lit(".load.c7."), kind), F.concat(F.lit("other."), kind, dot, who, F.lit(".x")), kind
    )
    name = F.element_at(forms, (F.col("event_id") % 4 + 1).cast("int"))
    named = apply_templates(name, TEMPLATES, "_", ["dc=one"])
    return table(spark, folder, "events").select("event_id", paths.canonical_tags(named).alias("path"))


# --- drops

DAY_NOW = "(Time - Time % 86400 + 43200)"


def _judged(spark: SparkSession, folder: str, **rules: int) -> DataFrame:
    """The points as if all of a day were received at noon."""
    p = _points(spark, folder)
    noon = F.col("Time") - F.col("Time") % 86400 + 43200
    return p.withColumn("reason", filters.drop_reason(F.col("Path"), F.col("Time"), noon, **rules))


@query(f"WITH {POINTS} SELECT seq FROM p WHERE Time > {DAY_NOW} + 3600")
def drop_future(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder, future=3600).where("reason = 'future'").select("seq")


@query(f"WITH {POINTS} SELECT seq FROM p WHERE {DAY_NOW} > Time + 7200")
def drop_past(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder, past=7200).where("reason = 'past'").select("seq")


@query(f"WITH {POINTS} SELECT seq FROM p WHERE strlen(Path) > 40")
def drop_long(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder, longest=40).where("reason = 'long'").select("seq")


REASONS = f"CASE WHEN Time > {DAY_NOW} + 3600 THEN 'future' WHEN {DAY_NOW} > Time + 7200 THEN 'past' WHEN strlen(Path) > 40 THEN 'long' END"


@query(f"WITH {POINTS} SELECT coalesce({REASONS}, 'kept') AS reason, count(*) AS n, sum(Time)::BIGINT AS times FROM p GROUP BY 1")
def drop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = _judged(spark, folder, future=3600, past=7200, longest=40)
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("Time").alias("times"))


@query(f"""
    WITH {POINTS}, last AS (SELECT * FROM p WHERE {REASONS} IS NOT NULL ORDER BY seq DESC LIMIT 1000)
    SELECT 'tcp/' || Path || '/' || Time || coalesce('/' || CASE WHEN isnan(Value) THEN 'NaN' WHEN isinf(Value) THEN CASE WHEN Value < 0 THEN '-' ELSE '' END || 'Infinity' ELSE printf('%.6f', Value) END, '') AS line FROM last
""")
def recent_drops(spark: SparkSession, folder: str) -> DataFrame:
    """A report of the last 1000 drops; values with six decimals, since engines write doubles differently."""
    rows = _judged(spark, folder, future=3600, past=7200, longest=40).where("reason IS NOT NULL")
    text = F.when(F.col("Value").isNotNull(), F.format_string("%.6f", "Value"))
    return filters.recent_drops(rows.withColumn("Value", text), "seq", "tcp")


@query("SELECT sample_id FROM prom_sample WHERE value IS NOT NULL AND CAST(value AS VARCHAR) <> 'nan'")
def nan_reject(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "prom_sample").where(numbers.is_number(F.col("value"))).select("sample_id")


@query(f"WITH {POINTS} SELECT seq FROM p WHERE Path <> 'stats.gateway.requests.count.sum'")
def blacklist_exact(spark: SparkSession, folder: str) -> DataFrame:
    return filters.without_blacklisted(_points(spark, folder), ["stats.gateway.requests.count.sum", "plant.hall1"]).select("seq")


@query(f"WITH {POINTS} SELECT seq FROM p WHERE contains(Path, '?') OR NOT regexp_matches(Path, '^(plant[.][^.]*[.][^.]*[.]bus1[.]volts|[^.]*[.][^.]*[.]cpu[.][^.]*[.]percent)$')")
def blacklist_wildcard(spark: SparkSession, folder: str) -> DataFrame:
    return filters.without_blacklisted(_points(spark, folder), ["plant.*.*.bus1.volts", "*.*.cpu.*.percent", "plant.ha*"]).select("seq")


# --- tables


@query(f"WITH {POINTS} SELECT CASE WHEN contains(Path, '?') THEN Path ELSE {S.reverse('Path')} END AS Path, Value, Time, Date, Timestamp FROM p")
def points_reverse(spark: SparkSession, folder: str) -> DataFrame:
    return tables.points_reverse(_points(spark, folder))


@query(f"WITH {POINTS} SELECT Path, Value, Time, Date, 0::BIGINT AS Timestamp FROM p")
def zero_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    return tables.points(_points(spark, folder), zero_timestamp=True)


PLAIN = f"{POINTS}, d AS (SELECT DISTINCT Date, Path, string_split(Path, '.') AS a FROM p WHERE NOT contains(Path, '?'))"
UNDATED = f"""
    SELECT DATE '{tables.TREE_DATE}' AS Date, CAST(20000 + len(a) AS BIGINT) AS Level, Path FROM d
    UNION SELECT DATE '{tables.TREE_DATE}', CAST(30000 + len(a) AS BIGINT), {S.reverse('Path')} FROM d
    UNION SELECT DATE '{tables.TREE_DATE}', CAST(20000 + k AS BIGINT), array_to_string(a[1:k], '.') || '.' FROM (SELECT a, unnest(generate_series(1, len(a) - 1)) AS k FROM d)
"""
DATED = f"""
    SELECT Date, CAST(len(a) AS BIGINT) AS Level, Path FROM d UNION SELECT Date, CAST(10000 + len(a) AS BIGINT), {S.reverse('Path')} FROM d
"""


@query(f"WITH {PLAIN} SELECT *, {VERSION}::BIGINT AS Version FROM ({UNDATED} UNION {DATED})")
def index_daily(spark: SparkSession, folder: str) -> DataFrame:
    return tables.index(_points(spark, folder), VERSION)


@query(f"WITH {PLAIN} SELECT *, {VERSION}::BIGINT AS Version FROM ({UNDATED})")
def index_nodaily(spark: SparkSession, folder: str) -> DataFrame:
    return tables.index(_points(spark, folder), VERSION, daily=False)


TAGGED = f"""
    {POINTS}, d AS (SELECT DISTINCT Date, Path FROM p WHERE contains(Path, '?') AND NOT starts_with(Path, '?')),
    pieces AS (SELECT Date, Path, ['__name__=' || url_decode(split_part(Path, '?', 1))]
        || list_transform(string_split(substr(Path, instr(Path, '?') + 1), '&'), lambda x: url_decode(replace(x, '+', ' '))) AS Tags FROM d)
"""


@query(f"WITH {TAGGED} SELECT Date, unnest(Tags) AS Tag1, Path, array_to_string(Tags, '|') AS Tags, {VERSION}::BIGINT AS Version FROM pieces")
def tagged_index(spark: SparkSession, folder: str) -> DataFrame:
    return tables.tagged(_points(spark, folder), VERSION).withColumn("Tags", F.array_join("Tags", "|"))


@query(f"""
    WITH {TAGGED}
    SELECT Date, Tag1, Path FROM (SELECT Date, unnest(Tags) AS Tag1, Path, Tags[1] AS name FROM pieces)
    WHERE name <> '__name__=mem.used.percent' OR Tag1 = name
""")
def tagged_ignored(spark: SparkSession, folder: str) -> DataFrame:
    return tables.tagged(_points(spark, folder), VERSION, ["mem.used.percent"]).drop("Tags", "Version")


@query(f"""
    WITH {PLAIN}
    SELECT DISTINCT CAST(len(a) AS BIGINT) AS Level, Path, {VERSION}::BIGINT AS Version FROM d
    UNION SELECT CAST(k AS BIGINT), array_to_string(a[1:k], '.') || '.', {VERSION}::BIGINT FROM (SELECT a, unnest(generate_series(1, len(a) - 1)) AS k FROM d)
""")
def tree_table(spark: SparkSession, folder: str) -> DataFrame:
    return tables.tree(_points(spark, folder), VERSION)


@query(f"WITH {PLAIN} SELECT Date, CAST(len(a) AS BIGINT) AS Level, Path, {VERSION}::BIGINT AS Version FROM d")
def series_table(spark: SparkSession, folder: str) -> DataFrame:
    return tables.series(_points(spark, folder), VERSION)


@query(f"WITH {PLAIN} SELECT Date, CAST(len(a) AS BIGINT) AS Level, {S.reverse('Path')} AS Path, {VERSION}::BIGINT AS Version FROM d")
def series_reverse(spark: SparkSession, folder: str) -> DataFrame:
    return tables.series(_points(spark, folder), VERSION, reversed_path=True)


# --- storage


@query("SELECT Date, Level, Path, max(Version) AS Version FROM graphite_index GROUP BY ALL")
def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    return storage.latest(table(spark, folder, "graphite_index"), storage.INDEX_KEY)


SPLIT_DAY = "2024-10-27"


@query(f"""
    SELECT DISTINCT Level, Path FROM graphite_index g WHERE Date >= DATE '{SPLIT_DAY}'
    AND NOT EXISTS (FROM graphite_index k WHERE k.Date < DATE '{SPLIT_DAY}' AND k.Path IS NOT DISTINCT FROM g.Path AND k.Level = g.Level)
""")
def dedup_new_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of later days that no earlier day has."""
    rows = table(spark, folder, "graphite_index").select("Date", "Level", "Path")
    day = F.lit(SPLIT_DAY).cast("date")
    later, earlier = rows.where(F.col("Date") >= day).drop("Date"), rows.where(F.col("Date") < day).drop("Date")
    return storage.new_keys(later, earlier, ["Level", "Path"])


@query(f"""
    WITH RECURSIVE u AS (SELECT DISTINCT Path, try_cast(split_part(chunk, '.', 2) AS BIGINT) // 1000000000 AS uploaded FROM graphite WHERE Path IS NOT NULL),
    through AS (
      SELECT Path, min(uploaded) AS uploaded FROM u GROUP BY Path
      UNION ALL
      SELECT t.Path, (SELECT min(u.uploaded) FROM u WHERE u.Path = t.Path AND u.uploaded > t.uploaded + {TTL}) FROM through t
      WHERE EXISTS (FROM u WHERE u.Path = t.Path AND u.uploaded > t.uploaded + {TTL}))
    SELECT Path, uploaded FROM through
""")
def ttl_reemit(spark: SparkSession, folder: str) -> DataFrame:
    """When each path is let through by a cache of twelve hours; uploads are chunks."""
    g = table(spark, folder, "graphite").where("Path IS NOT NULL")
    at = F.expr("try_cast(substring_index(chunk, '.', -1) AS bigint) div 1000000000").alias("uploaded")
    return storage.emitted_with_ttl(g.select("Path", at), ["Path"], "uploaded", TTL)


def _rolled(spark: SparkSession, folder: str, function: str | None = None) -> DataFrame:
    rules = read_rules(table(spark, folder, "rollup_rules"))
    if function:
        rules = [r.asDict() | {"function": function} for r in rules]
    p = _points(spark, folder).where("Value IS NOT NULL AND NOT isnan(Value) AND abs(Value) < double('infinity')")
    rows = storage.rollup(p, rules, ROLL_NOW)
    return rows.select("Path", "Time", F.round(F.col("Value") + 0.000331234, 2).alias("Value"), "Date")


ROLL_NOW = 1730300000 + 2592000
ROLL_SQL = f"""
    WITH {POINTS},
    named AS (
      SELECT Path, arg_min(r.regexp, r.rule_no) AS regexp, arg_min(r.function, r.rule_no) AS function
      FROM (SELECT DISTINCT Path FROM p) d, rollup_rules r WHERE r.regexp IS NULL OR regexp_matches(d.Path, r.regexp) GROUP BY Path),
    one AS (SELECT * FROM p WHERE isfinite(Value) QUALIFY row_number() OVER (PARTITION BY Path, Time ORDER BY Timestamp DESC NULLS LAST, Value DESC) = 1),
    aged AS (
      SELECT one.*, n.function, coalesce((SELECT arg_max(r.precision, r.age) FROM rollup_rules r WHERE r.regexp IS NOT DISTINCT FROM n.regexp AND r.age <= {ROLL_NOW} - one.Time), 1) AS step
      FROM one JOIN named n USING (Path))
    SELECT Path, Time - Time % step AS Time, round(FUNCTION + 0.000331234, 2) AS Value, max(Date) AS Date FROM aged GROUP BY Path, Time - Time % step, function
"""


@query(ROLL_SQL.replace("FUNCTION", "CASE function WHEN 'sum' THEN sum(Value) WHEN 'min' THEN min(Value) WHEN 'max' THEN max(Value) ELSE avg(Value) END"))
def rollup_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _rolled(spark, folder)


@query(ROLL_SQL.replace("FUNCTION", "avg(Value)"))
def rollup_avg(spark: SparkSession, folder: str) -> DataFrame:
    return _rolled(spark, folder, "avg")


@query(ROLL_SQL.replace("FUNCTION", "sum(Value)"))
def rollup_sum(spark: SparkSession, folder: str) -> DataFrame:
    return _rolled(spark, folder, "sum")


@query(ROLL_SQL.replace("FUNCTION", "min(Value)"))
def rollup_min(spark: SparkSession, folder: str) -> DataFrame:
    return _rolled(spark, folder, "min")


@query(ROLL_SQL.replace("FUNCTION", "max(Value)"))
def rollup_max(spark: SparkSession, folder: str) -> DataFrame:
    return _rolled(spark, folder, "max")


@query(f"WITH {POINTS} SELECT year(Date) * 100 + month(Date) AS month, count(*) AS n, count(DISTINCT Path) AS paths FROM p GROUP BY 1")
def month_partitions(spark: SparkSession, folder: str) -> DataFrame:
    p = _points(spark, folder).groupBy(numbers.month(F.col("Date")).cast("bigint").alias("month"), "Path").agg(F.count(F.lit(1)).alias("c"))
    return p.groupBy("month").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("paths"))


# --- search


@query("SELECT DISTINCT Path FROM graphite_index WHERE Level = 6 AND Date = DATE '2024-10-27' AND regexp_matches(Path, '^k8s[.]ns-billing[.][^.]*[.]cpu[.][^.]*[.]percent$')")
def find_glob(spark: SparkSession, folder: str) -> DataFrame:
    return search.find(table(spark, folder, "graphite_index"), "k8s.ns-billing.*.cpu.*.percent", "2024-10-27")


@query(f"SELECT DISTINCT {S.reverse('Path')} AS Path FROM graphite_index WHERE Level = 10006 AND Date = DATE '2024-10-26' AND regexp_matches(Path, '^bytes[.]rss[.]mem[.][^.]*[.][^.]*[.]k8s$')")
def find_glob_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """A glob with a fixed end goes to the reversed band."""
    return search.find(table(spark, folder, "graphite_index"), "k8s.*.*.mem.rss.bytes", "2024-10-26")


@query(f"WITH {TAGGED} SELECT DISTINCT Path FROM pieces WHERE list_contains(Tags, '__name__=mem.used.percent') AND list_contains(Tags, 'env=prod')")
def find_tags(spark: SparkSession, folder: str) -> DataFrame:
    return search.find_tags(tables.tagged(_points(spark, folder), VERSION), {"__name__": "mem.used.percent", "env": "prod"})


@query(f"WITH {TAGGED} SELECT seq, Path, Value, Time FROM p WHERE Time BETWEEN 1729900000 AND 1729990000 AND Path IN (SELECT Path FROM pieces WHERE list_contains(Tags, 'env=stage'))")
def fetch_series(spark: SparkSession, folder: str) -> DataFrame:
    p = _points(spark, folder)
    found = search.find_tags(tables.tagged(p, VERSION), {"env": "stage"})
    return search.fetch(p, found, 1729900000, 1729990000).select("seq", "Path", "Value", "Time")


# --- other sources


@query(f"""
    WITH m AS (SELECT *, regexp_full_match(timestamp, '[ \\t\\n\\r]*-?(0|[1-9][0-9]*)[ \\t\\n\\r]*') AND try_cast(trim(timestamp, ' ' || chr(9) || chr(10) || chr(13)) AS BIGINT) IS NOT NULL AS whole,
                 regexp_full_match(timestamp, '[ \\t\\n\\r]*-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?[ \\t\\n\\r]*') AS number FROM telegraf_metric),
    f AS (SELECT metric_id, name, coalesce(try_cast(trim(timestamp, ' ' || chr(9) || chr(10) || chr(13)) AS BIGINT), 0) AS t, tags, unnest(json_keys(fields)) AS k, fields FROM m WHERE timestamp IS NULL OR whole),
    v AS (SELECT *, json_type(fields, '$."' || k || '"') AS kind, json_extract_string(fields, '$."' || k || '"') AS x FROM f),
    e AS (SELECT *, list_sort(map_keys(tags)) AS ks FROM v WHERE kind IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN'))
    SELECT metric_id, {S.path_escape('name')} || CASE WHEN k = 'value' THEN '' ELSE '_' || {S.path_escape('k')} END || '?'
      || coalesce(array_to_string(list_transform(ks, lambda t: CASE WHEN t = 'name' AND len(ks) > 1 THEN '_name' ELSE {S.query_escape('t')} END || '=' || {S.query_escape('tags[t]')}), '&'), '') AS Path,
      CASE x WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE x::DOUBLE END AS Value, (t % 4294967296 + 4294967296) % 4294967296 AS Time, NULL AS error
    FROM e
    UNION ALL SELECT metric_id, NULL, NULL, NULL, CASE WHEN number THEN 'metrics: wrong kind of a part' ELSE 'no JSON object' END FROM m WHERE NOT (timestamp IS NULL OR whole)
""")
def telegraf_json(spark: SparkSession, folder: str) -> DataFrame:
    """A payload for each metric, with its time as it stood there; payloads with another kind of time give their error."""
    rest = F.to_json(F.struct(F.lit(1).alias("v"), "name", "tags"))
    body = F.concat(
        F.lit('{"metrics":['), F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(',"fields":'), F.coalesce("fields", F.lit("null")),
        F.lit(',"timestamp":'), F.coalesce("timestamp", F.lit("null")), F.lit("}]}"),
    )
    payloads = table(spark, folder, "telegraf_metric").select("metric_id", body.alias("value"))
    return telegraf.points(telegraf.payload_metrics(payloads, keep=("metric_id",))).select("metric_id", "Path", "Value", "Time", "error")


def _encoded(df: DataFrame, columns: list[str], make) -> DataFrame:
    """part, content: the rows encoded by `make`, in many bodies; what a sender would do."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in columns), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([f"{rows[0][0]}"]), pa.array([make(rows)], pa.binary())], names=["part", "content"])

    return df.select(*columns).mapInArrow(lambda it: run(b for b in it if b.num_rows), "part string, content binary")


@query(f"""
    WITH s AS (SELECT list_filter(labels, lambda x: x.name <> '__name__') AS o, list_filter(labels, lambda x: x.name = '__name__')[1]['value'] AS n, value, timestamp FROM prom_sample
               WHERE value IS NOT NULL AND CAST(value AS VARCHAR) <> 'nan' AND timestamp IS NOT NULL)
    SELECT n || '?' || array_to_string(list_transform(list_sort(list_transform(o, lambda x: x.name || chr(1) || x.value)),
             lambda t: {S.query_escape("split_part(t, chr(1), 1)")} || '=' || {S.query_escape("split_part(t, chr(1), 2)")}), '&') AS Path,
           value AS Value, ((CASE WHEN timestamp < 0 THEN -(-timestamp // 1000) ELSE timestamp // 1000 END) % 4294967296 + 4294967296) % 4294967296 AS Time FROM s
""")
def prom_remote_write(spark: SparkSession, folder: str) -> DataFrame:
    """Samples encoded as remote-write bodies and decoded again."""
    rows = table(spark, folder, "prom_sample").where("value IS NOT NULL AND timestamp IS NOT NULL")
    make = lambda rows: binary.put_remote_write([([(x["name"], x["value"]) for x in r[1]], [(r[2], r[3])]) for r in rows])
    return binary.remote_write(_encoded(rows, ["sample_id", "labels", "value", "timestamp"], make)).select("Path", "Value", "Time")


@query(f"WITH {EVENTS} SELECT Path, Value, Time FROM t")
def grpc_payload(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(
        F.concat(F.col("event_type"), F.lit(";user="), F.col("user_id"), F.lit(";app=shop:a;user="), F.col("user_id") + 1).alias("name"),
        "value", F.unix_timestamp("ts").alias("time"),
    )
    make = lambda rows: binary.put_payload([(n, [(t, v)]) for n, v, t in rows])
    return binary.payload(_encoded(e, ["name", "value", "time"], make)).select("Path", "Value", "Time")


@query(f"WITH {EVENTS} SELECT replace(Path, 'events.', 'events..') AS Path, Value, Time FROM e")
def pickle_points(spark: SparkSession, folder: str) -> DataFrame:
    import pickle
    import struct

    e = table(spark, folder, "events").select(
        F.concat(F.lit("events.."), F.col("event_type"), F.lit(".u"), F.col("user_id")).alias("name"), "value", F.unix_timestamp("ts").alias("time")
    )

    def make(rows: list[tuple]) -> bytes:
        body = pickle.dumps([(n, (t, v)) for n, v, t in rows], protocol=2)
        return struct.pack(">I", len(body)) + body

    return binary.pickled(_encoded(e, ["name", "value", "time"], make)).select("Path", "Value", "Time")


@query(f"""
    WITH {EVENTS}
    SELECT receiver, count(*) AS n, count(DISTINCT Path) AS paths, sum(Time)::BIGINT AS times
    FROM (SELECT 'tcp' AS receiver, Path, Time FROM e UNION ALL SELECT 'grpc', Path, Time FROM t UNION ALL SELECT 'pickle', replace(Path, 'events.', 'events..'), Time FROM e)
    GROUP BY receiver
""")
def fan_in(spark: SparkSession, folder: str) -> DataFrame:
    """Three receivers as one table of points."""
    points = (("tcp", _event_points(spark, folder)), ("grpc", grpc_payload(spark, folder)), ("pickle", pickle_points(spark, folder)))
    every = union([(name, df.select("Path", "Value", "Time")) for name, df in points])
    return every.groupBy("receiver").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("Path").alias("paths"), F.sum("Time").alias("times"))


def _row_files(spark: SparkSession, folder: str, lz4: bool) -> DataFrame:
    from seriesmill import sinks

    p = _points(spark, folder).where("Value IS NOT NULL")
    files = sinks.row_files(p, lz4).select(F.lit("default.1.lz4" if lz4 else "default.1").alias("path"), "content")
    return binary.row_files(files).select("Path", "Value", "Time", "Date", "Timestamp")


ROWS = f"WITH {POINTS} SELECT Path, Value, Time, Date, coalesce(Timestamp, 0) AS Timestamp FROM p WHERE Value IS NOT NULL"


@query(ROWS)
def rowbinary_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return _row_files(spark, folder, False)


@query(ROWS)
def rowbinary_lz4(spark: SparkSession, folder: str) -> DataFrame:
    return _row_files(spark, folder, True)


#: By event_id % 16: whether a record of a row file is damaged (its day isn't that of its time).
DAMAGED = 3


@query(f"""
    WITH e AS (SELECT user_id, event_id, event_type AS Path, value AS Value, {TIME} AS Time, CAST(ts AS DATE) AS Date,
                      min(CASE WHEN event_id % 16 = {DAMAGED} THEN event_id END) OVER (PARTITION BY user_id) AS broken FROM events)
    SELECT user_id::VARCHAR AS file, Path, Value, Time, Date, {NOW}::BIGINT AS Timestamp, NULL AS error FROM e WHERE broken IS NULL OR event_id < broken
    UNION ALL SELECT user_id::VARCHAR, NULL, NULL, NULL, NULL, NULL, 'day 0 of time ' || Time FROM e WHERE event_id = broken
""")
def rowbinary_damaged(spark: SparkSession, folder: str) -> DataFrame:
    """A row file for each user, some of which hold damaged records: the good prefix is kept, the rest gives an error."""
    import numpy as np
    import pyarrow as pa

    day = F.when(F.col("event_id") % 16 == DAMAGED, F.lit(0)).otherwise(F.unix_date(F.to_date("ts")))
    record = F.struct("event_id", "event_type", "value", F.unix_timestamp("ts").alias("time"), day.alias("day"))
    per = table(spark, folder, "events").groupBy(F.col("user_id").cast("string").alias("path")).agg(F.array_sort(F.collect_list(record)).alias("x"))

    def run(batches):
        for b in batches:
            made = []
            for x in b.column("x"):
                one = x.values
                made.append(binary.put_records(one.field("event_type"), *(one.field(c).to_numpy() for c in ("value", "time", "day")), np.full(len(one), NOW)))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(made, pa.binary())], names=["path", "content"])

    return binary.row_files(per.mapInArrow(run, "path string, content binary"))


@query(f"WITH {POINTS} SELECT seq, strftime(Date, '%Y-%m-%d') AS day FROM p")
def day_text(spark: SparkSession, folder: str) -> DataFrame:
    return _points(spark, folder).select("seq", numbers.day_text(F.col("Date")).alias("day"))


READ_POINTS = "SELECT Path, Time, count(*) AS n FROM p WHERE Path LIKE 'plant.hall1.%' OR Path LIKE '%.latency.seconds' OR Path LIKE 'mem.used.percent?env=prod%' GROUP BY Path, Time"


@query(f"WITH {POINTS} {READ_POINTS}")
def read_points(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader asks of the points: LIKE, OR, and duplicates removed by grouping."""
    return spark.sql(READ_POINTS.replace("FROM p", "FROM {p}"), p=_points(spark, folder))


@query(f"WITH {TAGGED} SELECT DISTINCT Path, array_to_string(list_sort(Tags), '|') AS Tags FROM pieces WHERE list_contains(Tags, 'env=prod') OR array_to_string(Tags, '|') LIKE '%mount=/data%'")
def read_tags(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader asks of the tag table: series by tags, each with its tags sorted."""
    return spark.sql(
        "SELECT DISTINCT Path, array_join(array_sort(Tags), '|') AS Tags FROM {t} WHERE Tag1 = 'env=prod' OR Tag1 LIKE 'mount=/data%'", t=tables.tagged(_points(spark, folder), VERSION)
    )


@query("""
    WITH l AS (SELECT DISTINCT Path, min(Date) OVER (PARTITION BY Path) AS d FROM graphite WHERE Path IS NOT NULL AND Date IS NOT NULL),
    a AS (SELECT Path, date_trunc('month', d)::DATE AS month, string_split(Path, '.') AS x FROM l),
    n AS (SELECT month, len(x) AS level, Path AS path FROM a
          UNION ALL SELECT month, k, array_to_string(x[1:k], '.') || '.' FROM (SELECT month, x, unnest(generate_series(1, len(x) - 1)) AS k FROM a))
    SELECT path, min(month) AS month, CAST(any_value(level) AS BIGINT) AS level FROM n GROUP BY path
""")
def tsv_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of a tab-separated dump of points."""
    g = table(spark, folder, "graphite").where("Path IS NOT NULL AND Date IS NOT NULL")
    lines = g.select(F.concat_ws("\t", "Path", F.lit("1"), F.lit("2"), F.date_format("Date", "yyyy-MM-dd")).alias("value"))
    return tables.tree_of_dump(lines)


@query(f"WITH {POINTS} SELECT seq, Date AS day FROM p")
def day_utc(spark: SparkSession, folder: str) -> DataFrame:
    return _points(spark, folder).select("seq", F.col("Date").alias("day"))


#: Epoch seconds at which Berlin's summer times begin and end.
SUMMER = ((1679792400, 1698541200), (1711846800, 1729990800), (1743296400, 1761440400))


@query(
    f"WITH {POINTS} SELECT seq, DATE '1970-01-01' + CAST((Time + CASE WHEN " + " OR ".join(f"Time >= {a} AND Time < {b}" for a, b in SUMMER)
    + " THEN 7200 ELSE 3600 END) // 86400 AS INTEGER) AS day FROM p"
)
def day_local(spark: SparkSession, folder: str) -> DataFrame:
    """The day in a zone whose summer time ends within the data."""
    return _points(spark, folder).select("seq", numbers.local_day(F.col("Time"), "Europe/Berlin").alias("day"))


# --- counters


@query(f"""
    WITH {POINTS}, n AS (SELECT count(*) AS received, count(*) FILTER ({REASONS} = 'future') AS future, count(*) FILTER ({REASONS} = 'past') AS past, count(*) FILTER ({REASONS} = 'long') AS long FROM p)
    SELECT 'agents.test.tcp.' || metric AS Path, value::DOUBLE AS Value, {NOW}::BIGINT AS Time FROM n UNPIVOT (value FOR metric IN (received AS 'received', future AS 'futureDropped', past AS 'pastDropped', long AS 'tooLongDropped'))
""")
def self_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows, seen = metrics.counted(_judged(spark, folder, future=3600, past=7200, longest=40))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(metrics.metric_rows(seen.get, "agents.test", "tcp", NOW), "Path string, Value double, Time bigint")


@query(f"""
    WITH {PLAIN}
    SELECT 'index' AS name, count(*) AS n FROM ({UNDATED} UNION {DATED})
    UNION ALL SELECT 'points', count(*) FROM p UNION ALL SELECT 'series', count(*) FROM d
    UNION ALL SELECT 'tagged', (SELECT sum(1 + len(string_split(substr(Path, instr(Path, '?') + 1), '&'))) FROM (SELECT DISTINCT Date, Path FROM p WHERE contains(Path, '?')))::BIGINT
""")
def fan_out_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches through the fan-out, the second of which brings nothing but what the first had; then what the tables hold."""
    root = f"{shared_folder(spark)}/fan-out-{uuid.uuid4().hex}"
    sinks = [fanout.Sink(kind, f"{root}/{kind}") for kind in ("points", "index", "series", "tagged")]
    p = _points(spark, folder)
    fanout.write_batch(p, 1, sinks, VERSION)
    fanout.write_batch(p, 2, sinks[1:], VERSION)
    out = None
    for s in sinks:
        one = spark.read.parquet(s.path).drop("batch").agg(F.lit(s.kind).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
