"""What the tables mean once stored: newest version wins, rollup, new keys, months."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from seriesmill.functions.numbers import month
from seriesmill.functions.rules import first_match

INDEX_KEY = ("Level", "Path", "Date")
TAGGED_KEY = ("Tag1", "Path", "Date")
#: Sort order within the files of each table.
ORDER = {"points": ("Path", "Time"), "points-reverse": ("Path", "Time"), "index": INDEX_KEY, "tagged": TAGGED_KEY}


def latest(df: DataFrame, key: Sequence[str], version: str = "Version") -> DataFrame:
    """Of the rows of a key one with the greatest version; nulls in keys are alike, a null version is the least.

    Where only key and version are columns this is max by hash aggregation; else a window limited to its first row,
    which Spark applies before the shuffle as well.
    """
    if set(df.columns) == {*key, version}:
        return df.groupBy(*key).agg(F.max(version).alias(version)).select(*df.columns)
    order = Window.partitionBy(*key).orderBy(F.col(version).desc_nulls_last())
    return df.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def rollup(points: DataFrame, rules: Iterable[Row], now: int) -> DataFrame:
    """Path, Time, Value, Date, Timestamp after rollup at `now`.

    Of several rows of a path and time the one received last counts. Its rule is the first matching pattern's: the
    precision is that of the greatest age the point has reached, the function the pattern's. Points that no rule
    matches stay as they are.
    """
    rules = sorted(rules, key=lambda r: r["rule_no"])
    path, age = F.col("Path"), F.lit(now) - F.col("Time")
    order = Window.partitionBy("Path", "Time").orderBy(F.col("Timestamp").desc_nulls_last(), F.col("Value").desc_nulls_last())
    one = points.where("Path IS NOT NULL AND Time IS NOT NULL").withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    first: Column | None = None  # number of the first matching pattern
    patterns: dict[str, list[Row]] = {}
    for r in rules:
        patterns.setdefault(r["regexp"] or "", []).append(r)
    step: Column | None = None
    for i, (regexp, own) in enumerate(patterns.items()):
        hit = path.rlike(regexp) if regexp else F.lit(True)
        by_age: Column | None = None
        for r in sorted(own, key=lambda r: -r["age"]):
            by_age = F.when(age >= r["age"], F.lit(r["precision"])) if by_age is None else by_age.when(age >= r["age"], F.lit(r["precision"]))
        first = F.when(hit, F.lit(i)) if first is None else first.when(hit, F.lit(i))
        step = F.when(hit, by_age) if step is None else step.when(hit, by_age)
    function = first_match(path, rules, "function", "string")
    kept = one.withColumn("_step", F.greatest(F.coalesce(step, F.lit(1)), F.lit(1)).cast("bigint")).withColumn("_function", F.coalesce(function, F.lit("avg")))
    slot = (F.col("Time") - F.pmod("Time", "_step")).alias("Time")
    value = (
        F.when(F.any_value("_function") == "sum", F.sum("Value")).when(F.any_value("_function") == "min", F.min("Value"))
        .when(F.any_value("_function") == "max", F.max("Value")).otherwise(F.avg("Value"))
    )
    return kept.groupBy("Path", slot).agg(value.alias("Value"), F.max("Date").alias("Date"), F.max("Timestamp").alias("Timestamp"))


def new_keys(batch: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of batch whose key isn't known, nulls alike, one for each key."""
    same = [batch[k].eqNullSafe(known[k]) for k in key]
    return batch.join(known, same, "left_anti").dropDuplicates(list(key))


def emitted_with_ttl(uploads: DataFrame, key: Sequence[str], time: str, ttl: int) -> DataFrame:
    """key and time of each upload that a cache with this TTL would let through.

    An entry counts from its insertion; hits don't prolong it. Uploads of a key are distinct upload times (files), not
    points, so a key's list is as long as the number of files that hold it.
    """
    times = uploads.groupBy(*key).agg(F.array_sort(F.collect_set(time)).alias("_t"))
    none = F.array().cast("array<bigint>")
    through = F.aggregate(
        "_t", none, lambda out, t: F.when((F.size(out) == 0) | (t - F.element_at(out, -1) > ttl), F.array_append(out, t)).otherwise(out)
    )
    return times.select(*key, F.explode(through).alias(time))


def write_table(df: DataFrame, path: str, kind: str, mode: str = "append", codec: str = "zstd") -> None:
    """Parquet by month, each task's rows in the table's order, so that row groups can be skipped by Path."""
    out = df.withColumn("month", month(F.col("Date"))) if "Date" in df.columns else df
    order = [c for c in ORDER.get(kind, ("Level", "Path")) if c in out.columns]
    if "month" in out.columns:
        out = out.repartition("month", order[0]).sortWithinPartitions("month", *order)
        out.write.mode(mode).option("compression", codec).partitionBy("month").parquet(path)
    else:
        out.sortWithinPartitions(*order).write.mode(mode).option("compression", codec).parquet(path)


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The rows of the days first..last; other months aren't read."""
    lo, hi = (int(d[:4]) * 100 + int(d[5:7]) for d in (first, last))
    return spark.read.parquet(path).where(F.col("month").between(lo, hi) & F.col("Date").between(first, last)).drop("month")
