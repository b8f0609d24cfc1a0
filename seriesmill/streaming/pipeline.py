"""A whole run from a configuration: all receivers as one stream, drop rules, templates, tables, counters.

build() makes the sources of the receivers that are enabled, one beside the other; start() fans them out into the tables of
[upload.*]. Receivers read what listeners left in `data.path`/<receiver>; tables go to `data.path`/tables/<name>.
The chunk interval is the trigger, the chunk's largest size what a trigger reads at most.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seriesmill.config import Config
from seriesmill.functions.templates import Template
from seriesmill.operators import filters
from seriesmill.sources import Tagging, source, union
from seriesmill.streaming import metrics
from seriesmill.streaming.fanout import Sink, fan_out, write_batch

#: Sections of receivers and the kinds of sources that read for them.
RECEIVERS = {"tcp": "tcp", "udp": "udp", "pickle": "pickle", "grpc": "grpc", "prometheus": "prometheus", "telegraf-http-json": "telegraf+http+json"}


@dataclass
class Pipeline:
    """points: receiver, the points, error and reason of all receivers; what start() or once() does with them."""

    points: DataFrame
    sinks: list[Sink]
    root: str
    prefix: str
    endpoint: str
    trigger: Mapping[str, object]
    #: Seconds between deliveries of counters.
    interval: float = 60.0
    query: StreamingQuery | None = field(default=None, init=False)
    pending: dict[str, float] = field(default_factory=dict, init=False)
    delivered: float = field(default=0.0, init=False)

    def _counted(self, now: int | None):
        """Counters of each batch, added up and handed over once an interval: as lines in a receiver's landing folder, from where they
        come back as points, or to their endpoint."""

        def count(rows: DataFrame) -> None:
            if not self.endpoint:
                return
            at = now if now is not None else int(time.time())
            for path, value, _ in metrics.receiver_rows(rows, self.prefix, at):
                self.pending[path] = self.pending.get(path, 0.0) + value
            if at - self.delivered >= self.interval:
                metrics.deliver(rows.sparkSession, [metrics.line((p, v, at)) for p, v in sorted(self.pending.items())], self.endpoint, f"{self.root}/tcp")
                self.pending, self.delivered = {}, at

        return count

    def start(self, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
        self.query = fan_out(
            self.points, self.sinks, f"{self.root}/checkpoint", drops=f"{self.root}/dropped", errors=f"{self.root}/errors", trigger=trigger or self.trigger,
            counted=self._counted(None),
        )
        return self.query

    def once(self, batch_id: int, version: int) -> None:
        """The same for points that aren't a stream."""
        write_batch(self.points, batch_id, self.sinks, version, drops=f"{self.root}/dropped", errors=f"{self.root}/errors", counted=self._counted(version))

    def confirm(self) -> None:
        """Returns when all that had been received is in the tables."""
        if self.query is not None:
            self.query.processAllAvailable()

    def stop(self, timeout: float = 60) -> None:
        """Ends the stream after the batch it is at."""
        if self.query is not None:
            self.query.stop()
            self.query.awaitTermination(int(timeout))


def dropped_lately(spark: SparkSession, root: str, receiver: str, most: int = 1000) -> DataFrame:
    """line: a report of the receiver's last drops."""
    rows = spark.read.parquet(f"{root}/dropped").where(F.col("receiver") == receiver).withColumn("_at", F.struct("batch", "Timestamp", "Time", "Path"))
    return filters.recent_drops(rows, "_at", receiver, most)


def sinks_of(config: Config, root: str) -> list[Sink]:
    out = []
    for name, u in config.uploads.items():
        kind = u["type"]
        options: dict[str, object] = {}
        if kind in ("points", "points-reverse"):
            options["zero_timestamp"] = u["zero-timestamp"]
        elif kind == "index":
            options |= {"tree_date": u["tree-date"], "daily": not u["disable-daily-index"]}
        elif kind == "tagged":
            options["name_only"] = tuple(u["ignored-tagged-metrics"])
        elif kind == "tree":
            options["date"] = u["date"] or None
        ignored = tuple(u["ignored-patterns"]) if kind in ("points", "points-reverse") else ()
        codec = "lz4" if u["compression"] == "lz4" else "zstd"
        out.append(Sink(kind, f"{root}/tables/{name}", int(u["cache-ttl"]), options, ignored, codec, u["url"]))
    return out


def build(spark: SparkSession, config: Config, stream: bool = True, now: int | None = None) -> Pipeline:
    """The run that the configuration describes. now: the time of receipt, where it isn't that of the files."""
    root = config.sections["data"]["path"].rstrip("/")
    tagged = config.sections["convert-to-tagged"]
    tagging = Tagging()
    if tagged["enabled"]:
        tagging = Tagging([Template.parse(t) for t in tagged["templates"]], tagged["separator"], tagged["tags"])
    data = config.sections["data"]
    found = []
    for name, kind in RECEIVERS.items():
        own = config.sections[name]
        if not own["enabled"]:
            continue
        options = {"stream": "1"} if stream else {}
        if stream and data["chunk-max-size"]:
            options["maxBytesPerTrigger"] = str(data["chunk-max-size"])
        if now is not None:
            options["now"] = str(now)
        if "concat" in own:
            options["concat"] = own["concat"]
        rows = source(spark, f"{kind}://{root}/{name}?{urlencode(options)}", tagging)
        reason = filters.drop_reason(F.col("Path"), F.col("Time"), F.col("Timestamp"), **config.drop_rules(name))
        day = F.col("Date") if data["utc-date"] else F.to_date(F.timestamp_seconds("Time"))
        found.append((name, rows.withColumn("Date", day).withColumn("reason", F.when(F.col("error").isNull(), reason))))
    common = config.sections["common"]
    waiting = sum(_files_in(spark, f"{root}/{name}") for name, _ in found) if data["chunk-auto-interval"].rules else 0
    seconds = data["chunk-auto-interval"].interval(waiting)
    return Pipeline(union(found), sinks_of(config, root), root, common["metric-prefix"], common["metric-endpoint"], {"processingTime": f"{max(1, round(seconds * 1000))} milliseconds"}, common["metric-interval"])


def _files_in(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(at).getFileCount()) if fs.exists(at) else 0
