"""`source(spark, dsn)`: canonical points from files of a kind, as a batch or a stream.

Network listeners leave what they receive in a landing folder; the kinds read such folders:

* plain: text files of lines, of any size, split among tasks.
* tcp, udp: a received block a file (what one connection or datagram brought). What follows the last line end is an
  unfinished line and left out.
* telegraf+http+json, prometheus, grpc: a body a file; pickle: frames.
* rows: chunk files `default.*`, packed or not.

Options stand in the query: stream=1, now (epoch seconds taken as the time of receipt), concat, zone, and the file
stream's maxFilesPerTrigger, maxBytesPerTrigger, cleanSource, sourceArchiveDir and latestFirst. Example: `prometheus:///spool/prom?stream=1`.

Each row is a point or an error. Bodies are held whole by a task, so they are limited to what a row may hold (2 GB).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.functions.numbers import utc_day
from seriesmill.functions.templates import Template
from seriesmill.sources import binary, plain, telegraf

#: A file's columns as the binaryFile source gives them, needed for streams.
_FILE = "path string, modificationTime timestamp, length bigint, content binary"
_STREAM_OPTIONS = ("maxFilesPerTrigger", "maxBytesPerTrigger", "cleanSource", "sourceArchiveDir", "latestFirst")


@dataclass(frozen=True)
class Tagging:
    """How plain names become tagged ones."""

    templates: Sequence[Template] = ()
    separator: str = "."
    tags: Sequence[str] = ()


Reader = Callable[[SparkSession, str, dict[str, str], Tagging], DataFrame]


def _open(spark: SparkSession, kind: str, options: dict[str, str], schema: str):
    if not options.get("stream"):
        return spark.read.format(kind)
    reader = spark.readStream.format(kind).schema(schema)
    for k in _STREAM_OPTIONS:
        if k in options:
            reader = reader.option(k, options[k])
    return reader


def _files(spark: SparkSession, path: str, options: dict[str, str], glob: str = "*") -> DataFrame:
    return _open(spark, "binaryFile", options, _FILE).option("pathGlobFilter", glob).load(path)


def _received(options: dict[str, str], modified: str = "modificationTime") -> Column:
    return (F.lit(int(options["now"])) if "now" in options else F.unix_timestamp(F.col(modified))).cast("bigint")


def _parsed(lines: DataFrame, tagging: Tagging) -> DataFrame:
    rows = plain.parse(lines.where(F.length("value") > 0), "value", F.col("_now"), tagging.templates, tagging.separator, tagging.tags)
    return rows.select("Path", "Value", "Time", "Timestamp", "error")


def _lines(spark: SparkSession, path: str, options: dict[str, str], tagging: Tagging) -> DataFrame:
    text = _open(spark, "text", options, "value string").option("lineSep", "\n").load(path)
    return _parsed(text.select("value", _received(options, "_metadata.file_modification_time").alias("_now")), tagging)


def _blocks(spark: SparkSession, path: str, options: dict[str, str], tagging: Tagging) -> DataFrame:
    blocks = _files(spark, path, options).select(F.col("content").cast("string").alias("block"), _received(options).alias("_now"))
    return _parsed(plain.complete_lines(blocks, "block").withColumnRenamed("line", "value"), tagging)


def _bodies(decoder: Callable[..., DataFrame]) -> Reader:
    def read(spark: SparkSession, path: str, options: dict[str, str], tagging: Tagging) -> DataFrame:
        files = _files(spark, path, options).select("content", _received(options).alias("Timestamp"))
        return decoder(files, keep=("Timestamp",)).select("Path", "Value", "Time", "Timestamp", "error")

    return read


def _telegraf(spark: SparkSession, path: str, options: dict[str, str], tagging: Tagging) -> DataFrame:
    files = _files(spark, path, options).select(F.col("content").cast("string").alias("value"), _received(options).alias("_received"))
    points = telegraf.points(telegraf.payload_metrics(files, keep=("_received",)), concat=options.get("concat", "_"))
    return points.select("Path", "Value", "Time", F.col("_received").alias("Timestamp"), "error")


def _rows(spark: SparkSession, path: str, options: dict[str, str], tagging: Tagging) -> DataFrame:
    rows = binary.row_files(_files(spark, path, options, "default.*"), options.get("zone", "UTC"))
    return rows.select("Path", "Value", "Time", "Timestamp", "error")


KINDS: dict[str, Reader] = {
    "tcp": _blocks, "udp": _blocks, "plain": _lines, "telegraf+http+json": _telegraf, "prometheus": _bodies(binary.remote_write),
    "pickle": _bodies(binary.pickled), "grpc": _bodies(binary.payload), "rows": _rows,
}


def source(spark: SparkSession, dsn: str, tagging: Tagging = Tagging()) -> DataFrame:
    """Path, Value, Time, Date (UTC), Timestamp (when received) and error of what the dsn names."""
    u = urlsplit(dsn)
    if u.scheme not in KINDS:
        raise ValueError(f"unknown source {u.scheme!r}; known are {', '.join(sorted(KINDS))}")
    rows = KINDS[u.scheme](spark, u.netloc + u.path, {k: v[-1] for k, v in parse_qs(u.query).items()}, tagging)
    return rows.select("Path", "Value", "Time", utc_day(F.col("Time")).alias("Date"), "Timestamp", "error")


def union(sources: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """All sources as one, with the name of each in `receiver`."""
    named = [df.withColumn("receiver", F.lit(name)) for name, df in sources]
    if not named:
        raise ValueError("no source")
    return reduce(DataFrame.unionByName, named)


def spool_delay(spark: SparkSession, path: str, now: int, glob: str = "default.*") -> DataFrame:
    """files and delay: how many chunk files wait in a spool, and the age in seconds of the oldest (0 without any).

    The age is told from the file's name, whose number is its start in nanoseconds; other names count by modification time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    start = F.coalesce(
        F.try_to_number(F.regexp_extract("path", r"default\.([0-9]{1,19})", 1), F.lit("9" * 19)).cast("bigint") / 1_000_000_000, F.unix_timestamp("modificationTime")
    )
    return files.agg(F.count(F.lit(1)).alias("files"), F.greatest(F.lit(0), F.coalesce(F.lit(now) - F.min(start.cast("bigint")), F.lit(0))).cast("bigint").alias("delay"))
