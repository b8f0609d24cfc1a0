"""Every source against what a sender would have written."""

import json
import pickle
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesmill import sinks
from seriesmill.functions.templates import Template
from seriesmill.sources import Tagging, binary, plain, source, spool_delay, telegraf, union, wire

NOW = 1700000000

LINES = [
    ("7", None), ("", None), ("pump..flow 7 ", None), ("pump..flow 7", None), ("pump.flow 7 t1500000000", None), ("pump.flow 7l 1500000000", None),
    ("pump.flow nan 1500000000", None), ("pump.flow 7 nan", None), ("pump.flow 7 -9", None), ("pump.flow 7 5000000000", None), ("p  1 2", None), ("p 1 2 3", None), ("p;q 1 2", None),
    ("pump.flow -0.125 1500000000", ("pump.flow", -0.125, 1500000000)), ("pump....flow 3.5 1500000001", ("pump.flow", 3.5, 1500000001)),
    ("pump.flow 3.5 1500000002\r\n", ("pump.flow", 3.5, 1500000002)), ("pump.flow;site=north;line=7 3.5 1500000003\r", ("pump.flow?line=7&site=north", 3.5, 1500000003)),
    ("pump..flow 3.5 -1", ("pump.flow", 3.5, NOW)), ("oven.heat;zone=b;door=open;zone=a 880.5 1500000004.7", ("oven.heat?door=open&zone=a", 880.5, 1500000004)),
    ("p inf 5", ("p", float("inf"), 5)),
]


def test_plain_lines(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(LINES)], "i int, value string, time string")
    got = {r.i: ((r.Path, r.Value, r.Time) if r.error is None else None) for r in plain.parse(df, "value", NOW).collect()}
    assert got == {i: w for i, (_, w) in enumerate(LINES)}
    assert plain.parse(df.select("i", F.lit(None).cast("string").alias("value")), "value", NOW).where("error = 'framing'").count() == len(LINES)
    long = spark.createDataFrame([("a" * 300000 + " 1 2",)], "value string")
    assert plain.parse(long, "value").select(F.length("Path")).first()[0] == 300000


def test_complete_lines(spark):
    df = spark.createDataFrame([("a 1 1\n\nb 2 2\nunfinished",), ("nothing",)], "value string")
    assert [r.line for r in plain.complete_lines(df).collect()] == ["a 1 1", "b 2 2"]


def test_telegraf(spark):
    metric = lambda **kw: json.dumps({"metrics": [kw]})
    good = {"metrics": [
        {"name": "oven heat/2", "timestamp": 1650000000, "fields": {"upper": 880}, "tags": {"door side": "left hand", "name": "old"}},
        {"name": "w", "timestamp": -2, "fields": {"value": 0.25, "note": "31", "on": False, "more": {"a": 1}, "gone": None}, "tags": {"name": "w1"}},
    ]}
    wrong = ["no json", "[1]", '{"metrics": 5}', '{"metrics": [5]}', metric(name="a", timestamp="17", fields={"x": 1}), metric(name="a", timestamp=1.5, fields={"x": 1}), metric(name=1, timestamp=1, fields={"x": 1})]
    empty = ["{}", '{"metrics": []}', '{"metrics": null}', metric(name="a", timestamp=1, tags={}), metric(name="a", timestamp=1, fields={})]
    df = spark.createDataFrame(list(enumerate([json.dumps(good), *wrong, *empty, metric(name="late", fields={"value": 1})])), "id int, value string")
    rows = telegraf.points(telegraf.payload_metrics(df, keep=("id",)), concat=".").collect()
    got = sorted((r.Path, r.Value, r.Time) for r in rows if not r.error)
    assert got == [("late?", 1.0, 0), ("oven%20heat/2.upper?door+side=left+hand&_name=old", 880.0, 1650000000), ("w.on?name=w1", 0.0, 4294967294), ("w?name=w1", 0.25, 4294967294)]
    assert sorted(r.id for r in rows if r.error) == [1, 2, 3, 4, 5, 6, 7] and all(r.Path is None for r in rows if r.error)


def bodies(spark, *contents):
    return spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "id int, content binary")


def test_remote_write(spark):
    good = binary.put_remote_write([
        ([("job", "a b"), ("__name__", "up"), ("env", "x")], [(1.5, 1999), (float("nan"), 5), (2.0, -1999)]),
        ([("__name__", "bare")], [(3.0, 5000)]),
    ])
    rows = binary.remote_write(bodies(spark, good, b"\x00\x01broken", binary.put_remote_write([([("job", "x")], [(1.0, 1)])]), None), keep=("id",)).collect()
    assert [(r.id, r.Path, r.Value, r.Time) for r in rows if r.error is None] == [(0, "up?env=x&job=a+b", 1.5, 1), (0, "up?env=x&job=a+b", 2.0, 4294967295), (0, "bare", 3.0, 5)]
    assert sorted(r.id for r in rows if r.error) == [1, 2]


def slow_label_path(labels):
    """The path of a sample's labels, the plain way: an own second implementation."""
    import urllib.parse

    names = [k for k, _ in labels]
    first = names.index("__name__")
    rest = sorted(((k, i, v) for i, (k, v) in enumerate(labels) if i != first))
    quote = lambda x: urllib.parse.quote(x, safe="-_.~").replace("%20", "+")
    return labels[first][1] + ("?" + "&".join(f"{quote(k)}={quote(v)}" for k, _, v in rest) if rest else "")


def test_remote_write_two_ways(spark):
    """Random label sets through the decoder and through the plain implementation."""
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("ab.*~é &=/%+") for _ in range(rng.randint(0, 6)))
    series = []
    for _ in range(300):
        labels = [("__name__", "m" + text())] + [(rng.choice("xyz") + text(), text()) for _ in range(rng.randint(0, 4))]
        rng.shuffle(labels)
        series.append((labels, [(rng.random(), rng.randint(-(10**12), 10**12))]))
    rows = binary.remote_write(bodies(spark, binary.put_remote_write(series))).collect()
    toward_zero = lambda ms: abs(ms) // 1000 * (1 if ms > 0 else -1)
    want = [(slow_label_path(labels), v, toward_zero(ms) % 2**32) for labels, ((v, ms),) in series]
    assert [(r.Path, r.Value, r.Time) for r in rows] == want


def test_payload(spark):
    good = binary.put_payload([("a;k=v", [(1, 2.0), (3, 4.0)]), ("b", [(5, 6.0)])])
    wrong = [binary.put_payload([("a", [(1, 1.0)]), ("bad;tag", [(1, 1.0)])]), binary.put_payload([("a", [])]), binary.put_payload([("x" * 16385, [(1, 1.0)])]), b"\x0a\x7f"]
    rows = binary.payload(bodies(spark, good, *wrong), keep=("id",)).collect()
    assert sorted((r.id, r.Path, r.Value, r.Time) for r in rows if r.error is None) == [(0, "a?k=v", 2.0, 1), (0, "a?k=v", 4.0, 3), (0, "b", 6.0, 5)]
    assert sorted(r.id for r in rows if r.error) == [1, 2, 3, 4]


class Evil:
    def __reduce__(self):
        return (print, ("executed",))


def frame(thing):
    data = pickle.dumps(thing, protocol=2)
    return struct.pack(">I", len(data)) + data


def test_pickle(spark, capfd):
    good = frame([("a..b;k=v", (1, 2.5)), ("bad;", (1, 1.0))]) + frame([("c", (7.9, float("nan")))])
    rows = binary.pickled(bodies(spark, good, frame([Evil()]), good[:9], b"\xff\xff\xff\xff"), keep=("id",)).collect()
    assert [(r.Path, r.Time) for r in rows if r.error is None] == [("a..b?k=v", 1), ("c", 7)]
    assert sorted(r.id for r in rows if r.error) == [1, 2, 3] and "refused" in next(r.error for r in rows if r.id == 1)


def test_wire():
    random.seed(3)
    for n in [0, 1, 127, 128, 2**32, 2**63, 2**64 - 1, -1]:
        assert wire.varint(wire.put_varint(n), 0)[0] == n % 2**64
    assert list(wire.fields(wire.put(1, "é") + wire.put(2, 7) + wire.put(3, 1.5))) == [(1, 2, "é".encode()), (2, 0, 7), (3, 1, struct.pack("<d", 1.5))]
    for broken in (b"\x08", b"\x0a\x05ab", b"\x0b", b"\x09\x00", b"\x80" * 11):
        with pytest.raises(wire.WireError):
            list(wire.fields(broken))


@pytest.mark.parametrize("lz4", [False, True])
def test_row_files(spark, tmp_path, lz4):
    rows = [(f"p{i}é", i / 3, 86400 * i + 5, i, i + 7) for i in range(50)]
    (tmp_path / ("default.1" + ".lz4" * lz4)).write_bytes(binary.put_rows(rows, lz4))
    (tmp_path / "default.2").write_bytes(binary.put_rows([*rows[:3], ("x", 1.0, 5, 9, 0), *rows[3:]]))
    (tmp_path / "other").write_bytes(b"no chunk")
    got = binary.row_files(spark.read.format("binaryFile").option("pathGlobFilter", "default.*").load(str(tmp_path))).collect()
    first = [r for r in got if "default.1" in r.file]
    assert [(r.Path, r.Value, r.Time, r.Timestamp) for r in first] == [(a, b, c, e) for a, b, c, _, e in rows]
    second = [r for r in got if "default.2" in r.file]
    assert len(second) == 4 and second[3].error and all(r.error is None for r in second[:3])
    assert source(spark, f"rows://{tmp_path}").where("error IS NULL").count() == 53


def test_row_files_fast_and_slow(spark):
    """Long names, names that are no UTF-8, days of a zone, damage at any place."""
    rows = [("n" * 200, 1.0, 5, 0, 1), ("", 2.0, 86400, 1, 2), ("é" * 70, -0.5, 2**32 - 1, 49710, 3)]
    data = binary.put_rows(rows)
    assert list(binary.read_rows(data)) == rows and list(binary.read_rows(b"")) == []
    assert binary.put_rows([]) == b""
    for cut in range(1, len(data)):
        got, error = binary.records(data[:cut])
        assert error is not None or cut in (220, 239) and len(got[0]) in (1, 2)
    bad = data.replace("é".encode() * 70, b"\xff" * 140)
    assert binary.records(bad)[0][0][2].as_py() == "\ufffd" * 140
    df = lambda *contents: spark.createDataFrame([(f"default.{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")
    berlin = binary.put_rows([("a", 1.0, 1719784800, 19905, 1), ("a", 1.0, 1719784799, 19904, 1)])  # midnight in July
    assert [r.error for r in binary.row_files(df(berlin), "Europe/Berlin").collect()] == [None, None]
    assert [r.error is None for r in binary.row_files(df(berlin)).collect()] == [False]
    packed = binary.put_rows(rows, lz4=True)
    broken = spark.createDataFrame([("default.1.lz4", bytearray(packed[: len(packed) // 2]))], "path string, content binary")
    assert [r.Path is None and r.error is not None for r in binary.row_files(broken).collect()][-1]


def test_generic_columns(spark):
    import datetime as dt

    table = spark.createDataFrame([("a", ["x", "yé"], 7, 2.5, dt.date(2020, 2, 29)), ("", [], 0, -1.0, dt.date(1970, 1, 1))], "Path string, Tags array<string>, Version bigint, Value double, Date date")
    data = b"".join(bytes(r[0]) for r in sinks.row_binary(table.coalesce(1)).collect())
    assert sorted(binary.read_columns(data, ("string", "strings", "u32", "f64", "date"))) == sorted(tuple(r) for r in table.collect())
    assert list(binary.read_columns(b"\x05\x01\x00" + b"\xff" * 8, ("u8", "u16", "u64"))) == [(5, 1, 2**64 - 1)]
    for damaged in (b"\x05a", b"\x01"):
        with pytest.raises(ValueError):
            list(binary.read_columns(damaged, ("string", "u16")))


def _land(folder):
    """A landing folder for each kind of source, with one good point `m` and what that kind leaves out."""
    for kind in ("plain", "tcp", "udp", "grpc", "prometheus", "pickle", "telegraf+http+json", "rows"):
        (folder / kind).mkdir(parents=True)
    for kind in ("plain", "tcp", "udp"):
        (folder / kind / "a").write_text("m..x 1 100\r\nbad\nn;t=1 2 2")
    (folder / "grpc" / "a").write_bytes(binary.put_payload([("m;t=1", [(100, 1.0), (101, 2.0)])]))
    (folder / "grpc" / "b").write_bytes(binary.put_payload([("m", [(100, 1.0)]), ("bad;", [(1, 1.0)])]))
    (folder / "prometheus" / "a").write_bytes(binary.put_remote_write([([("__name__", "m")], [(1.0, 100000)])]))
    (folder / "pickle" / "a").write_bytes(frame([("m", (100, 1.0))]) + b"\0")
    (folder / "telegraf+http+json" / "a").write_text('{"metrics":[{"name":"m","timestamp":100,"fields":{"value":1}}]}')
    (folder / "telegraf+http+json" / "b").write_text('{"metrics":[{"name":"m","timestamp":1')
    (folder / "rows" / "default.5").write_bytes(binary.put_rows([("m", 1.0, 100, 0, 5), ("m", 1.0, 100, 9, 5)]))


#: Points and numbers of errors that _land leaves for each kind.
LANDED = {
    "plain": ([("m.x", 100), ("n?t=1", 2)], 1), "tcp": ([("m.x", 100)], 1), "udp": ([("m.x", 100)], 1), "grpc": ([("m?t=1", 100), ("m?t=1", 101)], 1), "prometheus": ([("m", 100)], 0),
    "pickle": ([("m", 100)], 1), "telegraf+http+json": ([("m?", 100)], 1), "rows": ([("m", 100)], 1),
}


@pytest.mark.parametrize("stream", [False, True])
def test_every_kind_as_batch_and_stream(spark, tmp_path, stream):
    _land(tmp_path)
    for kind, (points, errors) in LANDED.items():
        df = source(spark, f"{kind}://{tmp_path}/{kind}?now=5" + "&stream=1" * stream)
        assert df.columns == ["Path", "Value", "Time", "Date", "Timestamp", "error"] and df.isStreaming == stream
        if stream:
            q = df.writeStream.format("memory").queryName(f"landed_{kind.partition('+')[0]}").trigger(availableNow=True).start()
            q.awaitTermination(120)
            df = spark.table(q.name)
        rows = df.collect()
        assert sorted((r.Path, r.Time) for r in rows if not r.error) == points, kind
        assert sum(r.error is not None for r in rows) == errors, kind
        assert {r.Timestamp for r in rows if not r.error} == {5}


def test_registry(spark, tmp_path):
    _land(tmp_path)
    both = union([(k, source(spark, f"{k}://{tmp_path}/{k}?now=5")) for k in ("tcp", "grpc")])
    assert {(r.receiver, r.Path) for r in both.where("error IS NULL").collect()} == {("tcp", "m.x"), ("grpc", "m?t=1")}
    tagged = source(spark, f"plain://{tmp_path}/plain", Tagging([Template.parse("*.x kind.measurement")]))
    assert sorted(r.Path for r in tagged.where("error IS NULL").collect()) == ["n?t=1", "x.?kind=m"]
    (tmp_path / "spool").mkdir()
    (tmp_path / "spool" / "default.7000000000").write_bytes(b"x")
    (tmp_path / "spool" / "default.9000000000.lz4").write_bytes(b"x")
    (tmp_path / "spool" / "other").write_bytes(b"x")
    assert tuple(spool_delay(spark, f"{tmp_path}/spool", 20).first()) == (2, 13)
    assert tuple(spool_delay(spark, f"{tmp_path}/plain", 20).first()) == (0, 0)
    with pytest.raises(ValueError):
        source(spark, "carrier-pigeon://x")
    with pytest.raises(ValueError):
        union([])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.b", 1.5, 86400, None, 3)], "Path string, Value double, Time bigint, Date date, Timestamp bigint").withColumn("Date", F.lit("1970-01-02").cast("date"))
    assert sinks.plain_lines(df).first()[0] == "a.b 1.5 86400"
    assert bytes(sinks.row_files(df).first()[0]) == binary.put_rows([("a.b", 1.5, 86400, 1, 3)])
    tags = df.select("Date", F.array(F.lit("x"), F.lit("y")).alias("Tags"), F.col("Timestamp").alias("Version"))
    assert bytes(sinks.row_binary(tags).first()[0]) == b"\x01\x00" + b"\x02\x01x\x01y" + b"\x03\x00\x00\x00"
    sinks.tab_separated(df, str(tmp_path / "out"))
    assert [t for p in (tmp_path / "out").glob("*.csv") if (t := p.read_text())] == ["a.b\t1.5\t86400\t1970-01-02\t3\n"]


def test_insert(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Store(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.path, self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([("a", 1)], "Path string, Version bigint")
    assert sinks.insert(df, f"http://127.0.0.1:{server.server_port}/", "t") == 1
    server.shutdown()
    assert len(got) == 1 and "insert_deduplication_token=" in got[0][0]
    assert "INSERT+INTO+t+%28Path%2C+Version%29+FORMAT+RowBinary" in got[0][0] and got[0][1] == b"\x01a\x01\x00\x00\x00"
