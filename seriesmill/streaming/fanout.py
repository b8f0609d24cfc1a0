"""One stream of points into many tables, each key once.

Every micro-batch is written under its batch id with dynamic overwrite, and the keys it added are recorded after the
rows, also under the batch id: a batch that is run again after a failure replaces itself. Keys expire `ttl` seconds after
their insertion; hits don't prolong them. Known keys are kept by day of insertion: days past the ttl are removed, and a day
that is over is merged into one folder, so that what a batch lists and reads doesn't grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seriesmill import sinks as outputs
from seriesmill.operators import filters, storage, tables

#: Keys by which each kind of table knows what it already holds.
KEYS = {"index": ("Date", "Path"), "tagged": ("Date", "Path"), "series": ("Date", "Path"), "series-reverse": ("Date", "Path"), "tree": ("Path",)}
_KNOWN = "Date date, Path string, inserted bigint, day bigint, batch bigint"
DAY = 86400
#: The batch under which a finished day's keys are merged.
MERGED = -1


@dataclass(frozen=True)
class Sink:
    """A table: its kind, where it goes, and how. ignored: patterns of plain paths left out; url: a store that gets the rows by HTTP as well."""

    kind: str
    path: str
    ttl: int = 0
    options: Mapping[str, object] | None = None
    ignored: tuple[str, ...] = ()
    codec: str = "zstd"
    url: str = ""


def _write(df: DataFrame, path: str, batch_id: int, codec: str = "zstd", by: tuple[str, ...] = ()) -> None:
    out = df.withColumn("batch", F.lit(batch_id).cast("bigint"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec).partitionBy(*by, "batch").parquet(path)


def write_batch(
    points: DataFrame, batch_id: int, sinks: list[Sink], version: int, drops: str | None = None, rules: Mapping[str, int] | None = None, errors: str | None = None,
    counted: Callable[[DataFrame], None] | None = None,
) -> None:
    """The tables of one batch. version: when it is uploaded, which is also the time of its keys' insertion.

    points may have `error` (rows that are no points; kept under `errors`) and `reason` (why a point is dropped, else by
    rules; kept under `drops`). counted gets the batch's rows for their counters.
    """
    points = points.persist()
    try:
        if counted:
            counted(points)
        rows = points
        if "error" in rows.columns:
            if errors:
                _write(rows.where("error IS NOT NULL"), errors, batch_id)
            rows = rows.where("error IS NULL").drop("error")
        if "reason" not in rows.columns:
            rows = rows.withColumn("reason", filters.drop_reason(F.col("Path"), F.col("Time"), F.col("Timestamp"), **(rules or {})))
        if drops:
            _write(rows.where("reason IS NOT NULL"), drops, batch_id)
        kept = rows.where("reason IS NULL").drop("reason")
        for s in sinks:
            _sink(filters.without_blacklisted(kept, s.ignored) if s.ignored else kept, s, batch_id, version)
    finally:
        points.unpersist()


def _sink(kept: DataFrame, s: Sink, batch_id: int, version: int) -> None:
    build = lambda rows: tables.BUILDERS[s.kind](rows, version, **(s.options or {}))
    if s.kind not in KEYS:
        out = build(kept)
    else:
        key = KEYS[s.kind]
        keys = KnownKeys(kept, s.path.rstrip("/") + "_keys", key)
        keys.tidy(version - s.ttl if s.ttl else None, version, batch_id)
        known = keys.read(batch_id, version - s.ttl if s.ttl else None)
        named = kept.where(F.col("Path").isNotNull())
        fresh = (storage.new_keys(named, known, key) if known is not None else named.dropDuplicates(list(key))).persist()
        out = build(fresh)
    _write(out, s.path, batch_id, s.codec)
    if s.url:
        outputs.insert(out, s.url, s.kind)
    if s.kind in KEYS:
        added = fresh.select(*key, F.lit(version).cast("bigint").alias("inserted"), F.lit(version // DAY).cast("bigint").alias("day"))
        _write(added, keys.path, batch_id, by=("day",))
        fresh.unpersist()


class KnownKeys:
    """The keys that a table holds: folders day=/batch= of the days on which they were inserted."""

    def __init__(self, df: DataFrame, path: str, key: tuple[str, ...]) -> None:
        self.spark, self.path, self.key = df.sparkSession, path, key
        self.at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, path, name: str) -> dict[int, object]:
        """The numbers of the folders name=number, with their paths."""
        if not self.fs.exists(path):
            return {}
        held = [(f.getPath().getName(), f.getPath()) for f in self.fs.listStatus(path)]
        return {int(n.removeprefix(f"{name}=")): p for n, p in held if n.startswith(f"{name}=")}

    def read(self, batch_id: int, oldest: int | None) -> DataFrame | None:
        """The keys that other batches inserted at `oldest` or later; None without any."""
        if not self._folders(self.at, "day"):
            return None
        known = self.spark.read.schema(_KNOWN).parquet(self.path).where(F.col("batch") != batch_id)
        if oldest is not None:
            known = known.where((F.col("day") >= oldest // DAY) & (F.col("inserted") >= oldest))
        return known.select(*self.key)

    def count(self) -> int:
        """How many different keys are known."""
        return self.spark.read.schema(_KNOWN).parquet(self.path).select(*self.key).distinct().count() if self._folders(self.at, "day") else 0

    def clear(self) -> None:
        """Forgets all keys: the next batch writes every series again."""
        self.fs.delete(self.at, True)

    def tidy(self, oldest: int | None, now: int, batch_id: int) -> None:
        """Removes days whose keys have all expired, and merges the folders of each day that is over.

        A merged day is written before its parts are removed. A key that stands twice in between does no harm.
        """
        for day, path in self._folders(self.at, "day").items():
            if oldest is not None and day < oldest // DAY:
                self.fs.delete(path, True)
            elif day < now // DAY and len(parts := {b: p for b, p in self._folders(path, "batch").items() if b != batch_id}) > 1:
                numbers = sorted(parts)
                rows = self.spark.read.schema(_KNOWN).parquet(self.path).where((F.col("day") == day) & F.col("batch").isin(numbers))
                whole = self.spark._jvm.org.apache.hadoop.fs.Path(path, "_merging")
                rows.select(*self.key, "inserted").distinct().write.mode("overwrite").parquet(whole.toString())
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path, f"batch={MERGED - max(numbers)}")
                if not self.fs.rename(whole, target):
                    continue
                for p in parts.values():
                    self.fs.delete(p, True)


def fan_out(
    points: DataFrame, sinks: list[Sink], checkpoint: str, version: int | None = None, drops: str | None = None, rules: Mapping[str, int] | None = None,
    trigger: Mapping[str, object] | None = None, errors: str | None = None, counted: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Starts the stream. version: fixed, else the time at which each batch begins."""
    import time

    def batch(df: DataFrame, batch_id: int) -> None:
        write_batch(df, batch_id, sinks, version if version is not None else int(time.time()), drops, rules, errors, counted)

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
