"""The engine's own counters, as points."""

from __future__ import annotations

import socket
import uuid
from collections.abc import Iterable, Iterator, Mapping
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(points: DataFrame, reason: str = "reason") -> tuple[DataFrame, Observation]:
    """points, and an observation of received, futureDropped, pastDropped and tooLongDropped, filled by the first action."""
    seen = Observation("points")
    hits = lambda what: F.count_if(F.coalesce(F.col(reason) == what, F.lit(False)))
    return points.observe(
        seen, F.count(F.lit(1)).alias("received"), hits("future").alias("futureDropped"), hits("past").alias("pastDropped"), hits("long").alias("tooLongDropped")
    ), seen


def metric_rows(values: Mapping[str, float], prefix: str, module: str, now: int) -> list[tuple[str, float, int]]:
    """(Path, Value, Time) `<prefix>.<module>.<metric>`."""
    return [(f"{prefix}.{module}.{k}", float(v), now) for k, v in sorted(values.items())]


def receiver_rows(rows: DataFrame, prefix: str, now: int) -> list[tuple[str, float, int]]:
    """metric_rows of a batch's rows (receiver, reason, error): what each receiver took, dropped and couldn't read."""
    hit = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    reason = F.col("reason")
    counts = rows.groupBy("receiver").agg(
        hit(F.col("error").isNull() & reason.isNull()).alias("metricsReceived"), hit(F.col("error").isNotNull()).alias("errors"),
        hit(reason == "future").alias("futureDropped"), hit(reason == "past").alias("pastDropped"), hit(reason == "long").alias("tooLongDropped"),
    )
    out = []
    for r in counts.orderBy("receiver").collect():  # a row a receiver
        values = r.asDict()
        out += metric_rows(values, prefix, values.pop("receiver"), now)
    return out


def line(row: tuple[str, float, int]) -> str:
    path, value, time = row
    return f"{path} {value:g} {time}"


#: Most bytes sent at once, by transport.
CHUNK = {"tcp": 32768, "udp": 1000}


def chunks(lines: Iterable[str], most: int) -> Iterator[bytes]:
    """Whole lines, in blocks of at most so many bytes; a longer line is a block of its own."""
    held = b""
    for x in lines:
        data = x.encode() + b"\n"
        if held and len(held) + len(data) > most:
            yield held
            held = b""
        held += data
    if held:
        yield held


def deliver(spark: SparkSession, lines: list[str], endpoint: str, landing: str) -> None:
    """Lines of counters to `tcp://host:port` or `udp://host:port`; with `local`, as a file in the landing folder, to be read like others."""
    if not lines:
        return
    if endpoint == "local":
        # no name with a leading underscore or dot, and complete once it has its name
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(landing)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        name = uuid.uuid4().hex
        part, whole = (jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f".{name}", f"metrics-{name}"))
        out = fs.create(part)
        out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
        out.close()
        fs.rename(part, whole)
        return
    u = urlsplit(endpoint)
    if u.scheme not in CHUNK:
        raise ValueError(f"unknown endpoint {endpoint!r}")
    with socket.socket(socket.AF_INET, socket.SOCK_STREAM if u.scheme == "tcp" else socket.SOCK_DGRAM) as s:
        s.settimeout(10)
        s.connect((u.hostname, u.port))
        for data in chunks(lines, CHUNK[u.scheme]):
            s.sendall(data)


class Collector(StreamingQueryListener):
    """Hands each batch's counters to `emit` as metric_rows."""

    def __init__(self, emit, prefix: str) -> None:
        self.emit, self.prefix = emit, prefix

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        import calendar
        import time

        p = event.progress
        now = calendar.timegm(time.strptime(p.timestamp[:19], "%Y-%m-%dT%H:%M:%S"))
        values = {"inputRows": p.numInputRows, "batchDurationMs": p.batchDuration}
        self.emit(metric_rows(values, self.prefix, p.name or "stream", now))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
