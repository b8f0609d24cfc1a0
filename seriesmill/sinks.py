"""Where rows go besides parquet tables: plain lines, tab-separated text, row files, an HTTP store."""

from __future__ import annotations

import gzip
import hashlib
import ssl
import struct
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.messages import in_blocks
from seriesmill.sources.binary import put_records
from seriesmill.sources.plain import format_line
from seriesmill.sources.wire import put_varint


def plain_lines(points: DataFrame) -> DataFrame:
    return points.select(format_line(F.col("Path"), F.col("Value"), F.col("Time")).alias("value"))


def tab_separated(points: DataFrame, path: str) -> None:
    points.select("Path", "Value", "Time", "Date", "Timestamp").write.option("sep", "\t").csv(path)


def row_files(points: DataFrame, lz4: bool = False, rows: int = 1 << 16) -> DataFrame:
    """content, lz4: the points as contents of row files of at most so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks((b for b in batches if b.num_rows), rows):
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                numbers = (part.column(c).to_numpy(zero_copy_only=False) for c in ("Value", "Time", "days", "Timestamp"))
                data = put_records(part.column("Path"), *numbers, lz4)
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([lz4])], names=["content", "lz4"])

    flat = points.where("Path IS NOT NULL AND Value IS NOT NULL AND Time IS NOT NULL AND Date IS NOT NULL").select(
        "Path", "Value", "Time", F.unix_date("Date").alias("days"), F.coalesce("Timestamp", F.lit(0)).cast("bigint").alias("Timestamp")
    )
    return flat.mapInArrow(run, "content binary, lz4 boolean")


def row_binary(table: DataFrame) -> DataFrame:
    """content: the rows of any table in the store's row format: texts with length, bigints as u32, dates as u16 days, doubles."""
    kinds = [f.dataType.simpleString() for f in table.schema.fields]

    def text(v: str) -> bytes:
        data = v.encode()
        return put_varint(len(data)) + data

    write = {
        "string": text,
        "double": lambda v: struct.pack("<d", v),
        "bigint": lambda v: struct.pack("<I", v & 0xFFFFFFFF),
        "int": lambda v: struct.pack("<H", v & 0xFFFF),
        "array<string>": lambda v: put_varint(len(v)) + b"".join(map(text, v)),
    }
    columns = [F.unix_date(c).alias(c) if k == "date" else F.col(c) for c, k in zip(table.columns, kinds, strict=True)]
    writers = [write["int" if k == "date" else k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b"".join(w(v) for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for w, v in zip(writers, row, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["content"])

    return table.select(*columns).mapInArrow(run, "content binary")


#: Bytes of rows that are posted at once, at least; a post holds whole batches.
POST_BYTES = 8 << 20


def insert(table: DataFrame, url: str, name: str, timeout: float = 60, packed: bool = False, ca_file: str | None = None, certificate: tuple[str, str] | None = None) -> int:
    """Posts the rows as `INSERT INTO name (columns) FORMAT RowBinary`; the number of posts.

    A failed post fails its task, which Spark runs again. Each post carries a token made of its content, by which a store
    leaves out what it has already taken. ca_file and certificate (file, key file) are paths that every executor has.
    """
    sep = "&" if "?" in url else "?"
    query = f"INSERT INTO {name} ({', '.join(table.columns)}) FORMAT RowBinary"

    def post(data: bytes, context: ssl.SSLContext | None) -> None:
        target = url + sep + urllib.parse.urlencode({"query": query, "insert_deduplication_token": hashlib.sha256(data).hexdigest()})
        request = urllib.request.Request(target, gzip.compress(data) if packed else data, {"Content-Encoding": "gzip"} if packed else {})
        with urllib.request.urlopen(request, timeout=timeout, context=context) as r:
            failed = [v for k, v in r.headers.items() if k.lower().endswith("exception-code")]
            if r.status != 200 or failed:
                raise OSError(f"status {r.status} {failed} {r.read()[:300]!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = ssl.create_default_context(cafile=ca_file) if url.startswith("https:") else None
        if context and certificate:
            context.load_cert_chain(*certificate)
        held: list[bytes] = []
        posts = 0
        for b in batches:
            held += b.column("content").to_pylist()
            if sum(map(len, held)) >= POST_BYTES:
                post(b"".join(held), context)
                held, posts = [], posts + 1
        if any(held):
            post(b"".join(held), context)
            posts += 1
        yield pa.RecordBatch.from_arrays([pa.array([posts], pa.int64())], names=["n"])

    return row_binary(table).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
