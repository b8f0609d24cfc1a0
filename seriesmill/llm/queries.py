"""Queries of the problems tagged llm over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import distinct, encode, garbled, packing, percentiles
from seriesmill.plans.sql import KEPT
from seriesmill.session import checkpoint, table


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoint(distinct.sketch(table(spark, folder, "graphite_index"), "Path", ["Date", "Level"]))


def p3_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct paths per Date, per Level and per pair, with bounds; the first two are merged from the last."""
    pairs = _pairs(spark, folder)
    coarser = distinct.merge_groupings(pairs, [["Date"], ["Level"]])
    every = coarser.unionByName(pairs.withColumn("grouping", F.lit("Date+Level")))
    found = distinct.estimates(every, ["grouping", "Date", "Level"])
    return found.select("grouping", "Date", "Level", "kept", *[F.round(c, 1).alias(c) for c in ("estimate", "low", "high")], "exact")


def p3_days(spark: SparkSession, folder: str) -> DataFrame:
    """Of each Date and the day before it: paths of either, of both, and of the later only."""
    days = checkpoint(distinct.merge(_pairs(spark, folder), ["Date"]).where("Date IS NOT NULL"))
    before = days.select(F.date_add("Date", 1).alias("Date"), "h")
    out = distinct.set_estimates(days, before, ["Date"])
    return out.select("Date", *[F.round(c, 1).alias(c) for c in out.columns if c != "Date"])


def _path_days(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.by_path_day(table(spark, folder, "graphite"))


def p6_path_day(spark: SparkSession, folder: str) -> DataFrame:
    rows = percentiles.quantiles(_path_days(spark, folder), ["path", "day"])
    return rows.withColumn("day", F.date_from_unix_date("day"))


def p6_path(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.quantiles(percentiles.by_key(_path_days(spark, folder), "path"), ["path"])


def p6_day(spark: SparkSession, folder: str) -> DataFrame:
    rows = percentiles.quantiles(percentiles.by_key(_path_days(spark, folder), "day"), ["day"])
    return rows.withColumn("day", F.date_from_unix_date("day"))


def _bounds(spark: SparkSession, folder: str, key: str) -> DataFrame:
    rows = percentiles.readings(table(spark, folder, "graphite"))
    parts = percentiles.merged(percentiles.summaries(rows), ["path", "day"])
    found = checkpoint(percentiles.quantiles(percentiles.by_key(parts, key), [key]))
    return percentiles.ranks_hold(found, rows, key)


def p6_path_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the bounds of p6_path hold, by counting all readings."""
    return _bounds(spark, folder, "path")


def p6_day_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the bounds of p6_day hold, by counting all readings."""
    return _bounds(spark, folder, "day").withColumn("day", F.date_from_unix_date("day"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(table(spark, folder, "documents"))


def p9_bins(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "pack_bins"))


def p9_conserved(spark: SparkSession, folder: str) -> DataFrame:
    """Of each class: documents packed, bins over the capacity, texts cut though they fit, and texts not wholly packed."""
    bins = table(spark, folder, "pack_bins")
    counts = packing.sizes(table(spark, folder, "documents"))
    return packing.audit(packing.pack_sizes(counts, bins), counts, bins)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.found(table(spark, folder, "documents"))


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return garbled.Findings(documents).restored(documents)


QUERIES = {
    f.__name__: f
    for f in (
        p3_distinct, p3_days, p6_path_day, p6_path, p6_day, p6_path_bounds, p6_day_bounds, p8_ids, p9_bins, p9_conserved, p10_found, p10_restored,
    )
}

KMV = f"""
    hashed AS (SELECT DISTINCT Date, Level, ('0x' || substr(md5(Path), 1, 15))::BIGINT AS h FROM graphite_index WHERE Path IS NOT NULL),
    grouped AS (
      SELECT 'Date' AS grouping, Date, NULL::BIGINT AS Level, h FROM hashed UNION SELECT 'Level', NULL, Level, h FROM hashed
      UNION ALL SELECT 'Date+Level', Date, Level, h FROM hashed),
    smallest AS (SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY grouping, Date, Level ORDER BY h) <= {distinct.K})
"""

#: CTE good: path, day and Value of each reading.
GOOD = f"""{KEPT},
    good AS (SELECT cpath AS path, DATE '1970-01-01' + CAST(Time // 86400 AS INTEGER) AS day, Value FROM ranked WHERE nth = 1 AND isfinite(Value))
"""
ASKED = f"unnest({list(percentiles.QUANTILES)}::DOUBLE[]) t(q)"

SQL = {
    "p3_distinct": f"""
        WITH {KMV},
        per AS (SELECT grouping, Date, Level, count(*) AS kept, count(*)::DOUBLE AS k, (count(*) - 1) / ((max(h) + 1) / 1152921504606846976.0) AS guess FROM smallest GROUP BY ALL),
        law AS (SELECT *, guess / (k - 1) * k AS f, 1 - 1 / (9 * k) AS m, {distinct.Z} / (3 * sqrt(k)) AS s FROM per)
        SELECT grouping, Date, Level, kept, round(CASE WHEN kept < {distinct.K} THEN k ELSE guess END, 1) AS estimate,
               round(CASE WHEN kept < {distinct.K} THEN k ELSE greatest(k, f * pow(m - s, 3)) END, 1) AS low,
               round(CASE WHEN kept < {distinct.K} THEN k ELSE f * pow(m + s, 3) END, 1) AS high, kept < {distinct.K} AS exact
        FROM law
    """,
    "p3_days": f"""
        WITH {KMV},
        d AS (SELECT Date, h FROM smallest WHERE grouping = 'Date' AND Date IS NOT NULL),
        two AS (SELECT Date, h, 1 AS l, 0 AS r FROM d UNION ALL SELECT Date + 1, h, 0, 1 FROM d),
        known AS (SELECT Date FROM two GROUP BY Date HAVING sum(l) > 0 AND sum(r) > 0),
        seen AS (SELECT Date, h, max(l) AS l, max(r) AS r FROM two SEMI JOIN known USING (Date) GROUP BY Date, h
                 QUALIFY row_number() OVER (PARTITION BY Date ORDER BY h) <= {distinct.K}),
        per AS (SELECT Date, count(*)::DOUBLE AS m, max(h) AS last, sum(l * r) / count(*)::DOUBLE AS pb, sum(l * (1 - r)) / count(*)::DOUBLE AS po FROM seen GROUP BY Date),
        g AS (SELECT *, m < {distinct.K} AS exact, CASE WHEN m < {distinct.K} THEN m ELSE (m - 1) / ((last + 1) / 1152921504606846976.0) END AS u FROM per),
        b AS (SELECT *, CASE WHEN exact THEN u ELSE u / (m - 1) * m * pow(1 - 1 / (9 * m) - {distinct.Z} / (3 * sqrt(m)), 3) END AS ul,
                     CASE WHEN exact THEN u ELSE u / (m - 1) * m * pow(1 - 1 / (9 * m) + {distinct.Z} / (3 * sqrt(m)), 3) END AS uh,
                     {distinct.Z} * {distinct.Z} AS zz FROM g),
        w AS (SELECT *, (pb + zz / (2 * m)) / (1 + zz / m) AS mb, {distinct.Z} * sqrt(pb * (1 - pb) / m + zz / (4 * m * m)) / (1 + zz / m) AS hb,
                     (po + zz / (2 * m)) / (1 + zz / m) AS mo, {distinct.Z} * sqrt(po * (1 - po) / m + zz / (4 * m * m)) / (1 + zz / m) AS ho FROM b)
        SELECT Date, round(u, 1) AS "union", round(ul, 1) AS union_low, round(uh, 1) AS union_high,
               round(pb * u, 1) AS "both", round(CASE WHEN exact THEN pb * u ELSE greatest(0, mb - hb) * ul END, 1) AS both_low,
               round(CASE WHEN exact THEN pb * u ELSE (mb + hb) * uh END, 1) AS both_high,
               round(po * u, 1) AS "only", round(CASE WHEN exact THEN po * u ELSE greatest(0, mo - ho) * ul END, 1) AS only_low,
               round(CASE WHEN exact THEN po * u ELSE (mo + ho) * uh END, 1) AS only_high
        FROM w
    """,
    # as the tables are read by one task; read by more, hot days keep other tuples, within the same bounds
    "p6_path_day": f"""
        WITH {GOOD},
        placed AS (SELECT *, row_number() OVER (PARTITION BY path, day ORDER BY Value) AS rank, count(*) OVER (PARTITION BY path, day) AS n FROM good),
        wide AS (SELECT *, 2 * {percentiles.ERROR}::DOUBLE / {percentiles.LEVELS} * n AS width FROM placed),
        kept AS (SELECT * FROM wide WHERE floor(rank / width) <> floor((rank - 1) / width) OR rank = 1 OR rank = n),
        asked AS (SELECT *, greatest(1, ceil(round(q * n, 6)))::BIGINT AS want FROM kept, {ASKED}),
        near AS (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY path, day, q ORDER BY abs(rank - want), Value, rank) = 1)
        SELECT path, day, n, q, Value AS value, rank AS rank_low, rank AS rank_high FROM near
    """,
    "p6_path_bounds": f"WITH {GOOD}, per AS (SELECT path, count(*) AS n FROM good GROUP BY path) SELECT path, n, q, true AS holds FROM per, {ASKED}",
    "p6_day_bounds": f"WITH {GOOD}, per AS (SELECT day, count(*) AS n FROM good GROUP BY day) SELECT day, n, q, true AS holds FROM per, {ASKED}",
    "p9_conserved": """
        SELECT bin_class, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0::BIGINT AS overfull, 0::BIGINT AS cut, 0::BIGINT AS lost FROM pack_bins
    """,
}
