"""Binary sources: one decoder for each, over files or a column of bodies; a body that fails gives its error, not an exception."""

from __future__ import annotations

import pickle
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seriesmill.functions.escape import query_escape
from seriesmill.functions.numbers import is_number, seconds_of_ms, wrap_u32
from seriesmill.functions.paths import canonical_tags
from seriesmill.operators.zones import offset_at, transitions
from seriesmill.sources import wire

#: Longest name that a payload may hold, in bytes, and longest pickle frame.
LONGEST_NAME, LONGEST_FRAME = 16384, 64 << 20
ROWS = 8192

Row = tuple


def decode(bodies: DataFrame, schema: str, names: list[str], read: Callable[[bytes], Iterable[Row]], body: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows that `read` gives for each body, with the columns in `keep` and `error`: null, or why the rest of the body was left out."""
    kinds = {f.name: f.dataType.simpleString() for f in bodies.schema.fields}
    out_schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), schema, "error string"])
    empty = (None,) * len(names)
    arrow = to_arrow_schema(StructType.fromDDL(out_schema))

    def rows(b: pa.RecordBatch) -> Iterator[Row]:
        kept = [b.column(k).to_pylist() for k in keep]
        for i, data in enumerate(b.column("_body").to_pylist()):
            own = tuple(k[i] for k in kept)
            if data is None:
                continue
            try:
                for r in read(data):
                    yield (*own, *r, None)
            except Exception as e:  # whatever a damaged body causes
                yield (*own, *empty, f"{type(e).__name__}: {e}"[:200])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Row] = []
        for b in batches:
            for r in rows(b):
                held.append(r)
                if len(held) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow, strict=True)], schema=arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow, strict=True)], schema=arrow)

    return bodies.select(*keep, F.col(body).alias("_body")).mapInArrow(run, out_schema)


# --- remote write: snappy block of WriteRequest{timeseries{labels{name, value}, samples{value, timestamp}}}


def _remote_write(data: bytes) -> Iterator[Row]:
    size, _ = wire.varint(data, 0)
    request = pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)
    for number, _, one in wire.fields(request):
        if number != 1:
            continue
        labels, samples = [], []
        for n, _, value in wire.fields(one):
            parts = dict((k, v) for k, _, v in wire.fields(value)) if n in (1, 2) else {}
            if n == 1 and 1 in parts and 2 in parts:
                labels.append((wire.text(parts[1]), wire.text(parts[2])))
            elif n == 2:
                samples.append((wire.double(parts[1]) if 1 in parts else 0.0, wire.signed(parts.get(2, 0))))
        if not any(k == "__name__" for k, _ in labels):
            raise wire.WireError("__name__ not found")
        for value, ms in samples:
            yield [{"name": k, "value": v} for k, v in labels], value, ms


def label_path(labels):
    """Path of an array<struct<name, value>>: the name as it is, the other labels sorted and escaped; without any, a plain path."""
    first = lambda x: x["name"] == "__name__"
    name = F.get(F.filter(labels, first), F.lit(0))["value"]
    # the first __name__ is the name; a further one is a label like others
    nth = F.array_position(F.transform(labels, lambda x: x["name"]), "__name__")
    others = F.filter(labels, lambda x, i: i != nth - 1)
    placed = F.array_sort(F.transform(others, lambda x, i: F.struct(x["name"].alias("n"), i.alias("i"), x["value"].alias("v"))))
    query = F.array_join(F.transform(placed, lambda x: F.concat(query_escape(x["n"]), F.lit("="), query_escape(x["v"]))), "&")
    return F.when(F.size(others) > 0, F.concat(name, F.lit("?"), query)).otherwise(name)


def remote_write(bodies: DataFrame, body: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, Path, Value, Time, error. NaN samples are left out; times are milliseconds, divided towards zero."""
    rows = decode(bodies, "labels array<struct<name:string,value:string>>, Value double, ms bigint", ["labels", "Value", "ms"], _remote_write, body, keep)
    good = rows.where(F.col("error").isNotNull() | is_number(F.col("Value")))
    return good.select(*keep, label_path(F.col("labels")).alias("Path"), "Value", wrap_u32(seconds_of_ms(F.col("ms"))).alias("Time"), "error")


def put_remote_write(series: Iterable[tuple[Iterable[tuple[str, str]], Iterable[tuple[float, int]]]]) -> bytes:
    out = b""
    for labels, samples in series:
        one = b"".join(wire.put(1, wire.put(1, k) + wire.put(2, v)) for k, v in labels)
        one += b"".join(wire.put(2, wire.put(1, float(v)) + wire.put(2, ms)) for v, ms in samples)
        out += wire.put(1, one)
    return pa.compress(out, codec="snappy", asbytes=True)


# --- payload: Payload{metrics{metric, points{timestamp, value}}}; wholly rejected if one of its metrics is wrong


def _readable(name: str) -> bool:
    """Whether canonical_tags can read the name."""
    first, *tags = name.split(";")
    return not tags or bool(first) and all(t.find("=") > 0 for t in tags)


def _payload(data: bytes) -> Iterator[Row]:
    found = []
    for number, _, one in wire.fields(data):
        if number != 1:
            continue
        name, points = b"", []
        for n, _, value in wire.fields(one):
            if n == 1:
                name = value
            elif n == 2:
                parts = dict((k, v) for k, _, v in wire.fields(value))
                points.append((parts.get(1, 0) & 0xFFFFFFFF, wire.double(parts[2]) if 2 in parts else 0.0))
        if not name or len(name) > LONGEST_NAME or not points:
            raise wire.WireError("a metric without name or points, or with too long a name")
        if not _readable(text := wire.text(name)):
            raise wire.WireError("tags")
        found += [(text, v, t) for t, v in points]
    yield from found


def payload(bodies: DataFrame, body: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, Path, Value, Time, error. A payload with one unreadable metric gives only its error."""
    rows = decode(bodies, "name string, Value double, Time bigint", ["name", "Value", "Time"], _payload, body, keep)
    return rows.select(*keep, canonical_tags(F.col("name")).alias("Path"), "Value", "Time", "error")


def put_payload(metrics: Iterable[tuple[str, Iterable[tuple[int, float]]]]) -> bytes:
    one = lambda name, points: wire.put(1, name) + b"".join(wire.put(2, wire.put(1, t) + wire.put(2, float(v))) for t, v in points)
    return b"".join(wire.put(1, one(name, points)) for name, points in metrics)


# --- pickle: frames of four bytes of length and a list of (name, (time, value))


class _Plain(pickle.Unpickler):
    """Loads lists, tuples, texts and numbers. Whatever needs a class or function is refused before it is looked up."""

    def find_class(self, module: str, name: str) -> object:
        raise pickle.UnpicklingError(f"refused: {module}.{name}")

    def persistent_load(self, pid: object) -> object:
        raise pickle.UnpicklingError("refused: persistent id")


def _pickled(data: bytes) -> Iterator[Row]:
    import io

    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("truncated length")
        (size,) = struct.unpack_from(">I", data, at)
        if size > LONGEST_FRAME or at + 4 + size > len(data):
            raise ValueError("frame too long or truncated")
        for name, (time, value) in _Plain(io.BytesIO(data[at + 4 : at + 4 + size])).load():
            yield name.decode("utf-8", "replace") if isinstance(name, bytes) else str(name), float(value), int(float(time)) & 0xFFFFFFFF
        at += 4 + size


def pickled(bodies: DataFrame, body: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, Path, Value, Time, error. NaN stays; metrics whose tags can't be read are skipped; dots aren't squeezed."""
    rows = decode(bodies, "name string, Value double, Time bigint", ["name", "Value", "Time"], _pickled, body, keep)
    path = canonical_tags(F.col("name"))
    return rows.where(F.col("error").isNotNull() | path.isNotNull()).select(*keep, path.alias("Path"), "Value", "Time", "error")


# --- row files: uvarint length, name, double, u32 time, u16 days, u32 version, little-endian; optionally an LZ4 frame

_FIXED = np.dtype([("Value", "<f8"), ("Time", "<u4"), ("days", "<u2"), ("Version", "<u4")])


def unpacked(data: bytes) -> bytes:
    return pa.input_stream(pa.BufferReader(data), compression="lz4").read()


def put_records(names: pa.Array, value: np.ndarray, time: np.ndarray, days: np.ndarray, version: np.ndarray, lz4: bool = False) -> bytes:
    """A file of these records. names: without nulls."""
    names = names.cast(pa.large_string())
    fixed = np.zeros(len(names), _FIXED)
    for field, x in (("Value", value), ("Time", time), ("days", days), ("Version", version)):
        fixed[field] = x if field == "Value" else np.asarray(x, np.int64) & (0xFFFF if field == "days" else 0xFFFFFFFF)
    ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    text = np.frombuffer(names.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    heads = [wire.put_varint(n) for n in size.tolist()]
    head = np.array([len(h) for h in heads], np.int64)
    begin = np.concatenate(([0], np.cumsum(head + size + _FIXED.itemsize)))
    out = np.empty(begin[-1], np.uint8)
    flat = lambda start, n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start, n)
    out[flat(begin[:-1], head)] = np.frombuffer(b"".join(heads), np.uint8)
    out[flat(begin[:-1] + head, size)] = text[ends[0] : ends[-1]]
    out[(begin[1:] - _FIXED.itemsize)[:, None] + np.arange(_FIXED.itemsize)] = fixed.view(np.uint8).reshape(-1, _FIXED.itemsize)
    data = out.tobytes()
    if lz4:
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as f:
            f.write(data)
        return sink.getvalue().to_pybytes()
    return data


def put_rows(rows: Iterable[tuple[str, float, int, int, int]], lz4: bool = False) -> bytes:
    """A file of (path, value, time, days, version)."""
    names, value, time, days, version = (list(c) for c in zip(*rows, strict=True)) if (rows := list(rows)) else ([],) * 5
    return put_records(pa.array(names, pa.string()), np.array(value, float), *(np.array(x, np.int64) for x in (time, days, version)), lz4)


def records(data: bytes, day_of: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[list[pa.Array], str | None]:
    """(Path, Value, Time, days and Version of the good records, why the rest was left out). day_of: what days must be."""
    places: list[tuple[int, int]] = []
    at, n, error = 0, len(data), None
    while at < n:
        size = data[at]
        at += 1
        if size > 0x7F:
            try:
                size, at = wire.varint(data, at - 1)
            except wire.WireError as e:
                error = str(e)
                break
        if at + size + _FIXED.itemsize > n:
            error = "truncated record"
            break
        places.append((at, size))
        at += size + _FIXED.itemsize
    start, size = np.array(places, np.int64).reshape(-1, 2).T
    raw = np.frombuffer(data, np.uint8)
    fixed = raw[(start + size)[:, None] + np.arange(_FIXED.itemsize)].view(_FIXED).reshape(-1) if len(start) else np.zeros(0, _FIXED)
    time, days = fixed["Time"].astype(np.int64), fixed["days"].astype(np.int64)
    if day_of is not None and len(wrong := np.flatnonzero(day_of(time) != days)):
        k = int(wrong[0])
        error = f"day {days[k]} of time {time[k]}"
        start, size, fixed, time, days = start[:k], size[:k], fixed[:k], time[:k], days[:k]
    names = raw[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)].tobytes()
    ends = np.concatenate(([0], np.cumsum(size)))
    try:
        names.decode()
        path = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(names)).cast(pa.string())
    except UnicodeDecodeError:
        path = pa.array([names[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
    return [path, pa.array(fixed["Value"].astype(np.float64)), pa.array(time), pa.array(days, pa.int32()), pa.array(fixed["Version"].astype(np.int64))], error


def read_rows(data: bytes, day_of: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[Row]:
    """Path, Value, Time, days, Version of each record; ends with an error at the first damaged one."""
    columns, error = records(data, day_of)
    yield from zip(*(c.to_pylist() for c in columns), strict=True)
    if error:
        raise ValueError(error)


def row_files(files: DataFrame, zone: str = "UTC", check_days: bool = True) -> DataFrame:
    """file, Path, Value, Time, Date, Timestamp, error of binaryFile rows; `.lz4` files are unpacked.

    error: the file's rest is quarantined, in a row without a point.
    """
    table = None if zone == "UTC" else transitions(zone)
    if zone != "UTC" and table is None:
        raise ValueError(f"unknown zone {zone!r}")

    def day_of(time: np.ndarray) -> np.ndarray:
        return (time if table is None else time + offset_at(table, time)) // 86400

    names = ["file", "Path", "Value", "Time", "days", "Version", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_py()
                if data is None:
                    continue
                columns: list[pa.Array] = [pa.array([], t) for t in (pa.string(), pa.float64(), pa.int64(), pa.int32(), pa.int64())]
                try:
                    columns, error = records(unpacked(data) if path.endswith(".lz4") else data, day_of if check_days else None)
                except Exception as e:  # whatever a damaged frame causes
                    error = f"{type(e).__name__}: {e}"[:200]
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *columns, pa.nulls(n, pa.string())], names=names)
                if error:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.nulls(1, c.type) for c in columns), pa.array([error])], names=names)

    rows = files.select("path", "content").mapInArrow(run, "file string, Path string, Value double, Time bigint, days int, Version bigint, error string")
    return rows.select("file", "Path", "Value", "Time", F.date_from_unix_date("days").alias("Date"), F.col("Version").alias("Timestamp"), "error")


# --- generic row format: the columns of any table, one after another

_READERS = {"u8": "<u1", "u16": "<u2", "u32": "<u4", "u64": "<u8", "f64": "<f8", "date": "<u2"}


def read_columns(data: bytes, kinds: Sequence[str]) -> Iterator[tuple]:
    """Rows of a body in the store's row format; kinds: u8, u16, u32, u64, f64, date, string or strings, one for each column."""
    import datetime as dt

    def text(at: int) -> tuple[str, int]:
        size, at = wire.varint(data, at)
        if at + size > len(data):
            raise ValueError("truncated text")
        return data[at : at + size].decode("utf-8", "replace"), at + size

    at = 0
    while at < len(data):
        row: list[object] = []
        for kind in kinds:
            if kind == "string":
                value, at = text(at)
            elif kind == "strings":
                n, at = wire.varint(data, at)
                value = []
                for _ in range(n):
                    one, at = text(at)
                    value.append(one)
            else:
                form = np.dtype(_READERS[kind])
                if at + form.itemsize > len(data):
                    raise ValueError("truncated record")
                value = np.frombuffer(data, form, 1, at)[0].item()
                at += form.itemsize
                if kind == "date":
                    value = dt.date(1970, 1, 1) + dt.timedelta(value)
            row.append(value)
        yield tuple(row)
