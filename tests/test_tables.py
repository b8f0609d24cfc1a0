"""Tables, storage, search, filters: golden cases and the fan-out stream."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from seriesmill import config
from seriesmill.__main__ import main
from seriesmill.operators import filters, search, storage, tables
from seriesmill.sources import binary, plain
from seriesmill.streaming import fanout, metrics, pipeline

LINES = """mill.line7.motor.rpm 810.5 1625478240
mill.line7.motor.rpm 799 1625478300
motor.rpm;site=north;line=l7 55.25 1625478300
odd_tags;bar=|;amp=&;pct=100%;plus=1+1;low=a_b;at=@;quote=';way/2=x/y 5.5 1625478360
ofen.größe;alt=ja 1.75 1625478240""".split("\n")
DAY, TREE = dt.date(2021, 7, 5), dt.date(1970, 2, 12)


@pytest.fixture(scope="module")
def points(spark):
    rows = plain.parse(spark.createDataFrame([(x,) for x in LINES], "value string"), "value", 1625478400)
    return rows.withColumn("Date", F.to_date(F.timestamp_seconds("Time"))).select("Path", "Value", "Time", "Date", "Timestamp").persist()


def test_index(points):
    got = sorted((r.Date, r.Level, r.Path) for r in tables.index(points, 7).collect())
    tree = [(TREE, 20001, "mill."), (TREE, 20002, "mill.line7."), (TREE, 20003, "mill.line7.motor."), (TREE, 20004, "mill.line7.motor.rpm"), (TREE, 30004, "rpm.motor.line7.mill")]
    assert got == [*tree, (DAY, 4, "mill.line7.motor.rpm"), (DAY, 10004, "rpm.motor.line7.mill")]
    assert sorted((r.Date, r.Level, r.Path) for r in tables.index(points, 7, daily=False).collect()) == tree


def test_tagged(points):
    got = {(r.Tag1, r.Path): sorted(r.Tags) for r in tables.tagged(points, 7).collect()}
    path = "odd_tags?amp=%26&at=%40&bar=%7C&low=a_b&pct=100%25&plus=1%2B1&quote=%27&way%2F2=x%2Fy"
    all_tags = ["__name__=odd_tags", "amp=&", "at=@", "bar=|", "low=a_b", "pct=100%", "plus=1+1", "quote='", "way/2=x/y"]
    assert {t: got[t, path] for t in all_tags} == {t: all_tags for t in all_tags}
    ascii_path = "ofen.gr%C3%B6%C3%9Fe?alt=ja"
    assert got["__name__=ofen.größe", ascii_path] == ["__name__=ofen.größe", "alt=ja"]
    assert len(got) == 3 + 9 + 2
    few = tables.tagged(points, 7, ["motor.rpm"]).where("Path LIKE 'motor%'").collect()
    assert [(r.Tag1, len(r.Tags)) for r in few] == [("__name__=motor.rpm", 3)]
    assert tables.tagged(points, 7, ["*"]).count() == 3


def test_other_tables(points, spark):
    assert sorted(r.Path for r in tables.points_reverse(points, True).where("NOT Path LIKE '%?%'").collect()) == ["rpm.motor.line7.mill"] * 2
    assert tables.points(points, True).where("Timestamp <> 0").count() == 0
    assert sorted((r.Level, r.Path) for r in tables.tree(points, 7).collect()) == [(1, "mill."), (2, "mill.line7."), (3, "mill.line7.motor."), (4, "mill.line7.motor.rpm")]
    assert tables.tree(points, 7, "2020-01-01").columns == ["Date", "Level", "Path", "Version"]
    assert [(r.Date, r.Level, r.Path) for r in tables.series(points, 7, True).collect()] == [(DAY, 4, "rpm.motor.line7.mill")]
    dot = spark.createDataFrame([("a.b.",)], "Path string")
    assert tables.tree(dot, 1, compat=True).count() == 1 and tables.tree(dot, 1).count() == 3
    odd = points.limit(0).unionByName(spark.createDataFrame([(None, 1.0, 1, None, 1), ("?k=v", 1.0, 1, None, 1), ("", 1.0, 1, None, 1)], points.schema))
    assert tables.tagged(odd, 1).count() == 0 and tables.index(odd, 1).count() == 4


def test_latest_and_new_keys(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, 9, "y"), (None, 1, 2, "z"), (None, 1, None, "w")], "Path string, Level int, Version int, extra string")
    assert sorted((r.Path or "", r.extra) for r in storage.latest(rows, ["Path", "Level"]).collect()) == [("", "z"), ("a", "y")]
    assert sorted((r.Path or "", r.Version) for r in storage.latest(rows.drop("extra"), ["Path", "Level"]).collect()) == [("", 2), ("a", 9)]
    known = spark.createDataFrame([(None, 1)], "Path string, Level int")
    assert [r.Path for r in storage.new_keys(rows, known, ["Path", "Level"]).collect()] == ["a"]


def test_ttl(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 5, 10, 11, 12, 30)], "Path string, t bigint")
    assert sorted(r.t for r in storage.emitted_with_ttl(rows, ["Path"], "t", 10).collect()) == [0, 11, 30]


RULES = [
    {"rule_no": 1, "regexp": r"\.sum$", "function": "sum", "age": 0, "precision": 10}, {"rule_no": 2, "regexp": r"\.sum$", "function": "sum", "age": 1000, "precision": 100},
    {"rule_no": 3, "regexp": None, "function": "avg", "age": 0, "precision": 10},
]


def test_rollup(spark):
    day = dt.date(1970, 1, 1)
    rows = [("a.sum", 1.0, 5000, day, 1), ("a.sum", 2.0, 5009, day, 1), ("a.sum", 7.0, 5009, day, 3), ("a.sum", 1.0, 10, day, 1), ("a.sum", 1.0, 90, day, 1), ("b", 1.0, 5000, day, 1), ("b", 4.0, 5005, day, 1), (None, 1.0, 1, day, 1)]
    df = spark.createDataFrame(rows, "Path string, Value double, Time bigint, Date date, Timestamp bigint")
    assert sorted((r.Path, r.Time, r.Value) for r in storage.rollup(df, RULES, 5010).collect()) == [("a.sum", 0, 2.0), ("a.sum", 5000, 8.0), ("b", 5000, 2.5)]


def test_months_are_pruned(spark, tmp_path, points):
    df = points.unionByName(points.withColumn("Date", F.date_add("Date", 60)))
    storage.write_table(df, str(tmp_path / "t"), "points")
    got = storage.read_days(spark, str(tmp_path / "t"), "2021-07-01", "2021-07-31")
    assert got.count() == points.count() and "month" not in got.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1][:200]


def test_filters(spark, column):
    cases = [("p", 111, 100, "future"), ("p", 110, 100, None), ("p", 79, 100, "past"), ("p", 80, 100, None), ("éé", 100, 100, "long"), ("abc", 100, 100, None), ("éé", 200, 100, "future")]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, Path string, Time bigint, Timestamp bigint")
    kept, dropped = filters.split_drops(df, future=10, past=20, longest=3)
    assert {r.i: r.reason for r in dropped.collect()} == {i: c[3] for i, c in enumerate(cases) if c[3]} and kept.count() == 3
    assert filters.split_drops(df)[1].count() == 0
    lines = [r.line for r in filters.recent_drops(dropped.withColumn("Value", F.lit(1.5)), "i", "tcp", 2).collect()]
    assert lines == sorted(lines) and len(lines) == 2
    names = ["a.b.c", "a.x.c", "a.b", "abc.b.c", "a.b.c?k=v", "z.t", "a.b.c.d", None]
    assert column(lambda x: filters.blacklisted(x, ["a.*.c", "z.t*"]), names) == [True, True, False, False, False, False, False, None]
    assert column(lambda x: filters.blacklisted(x, ["a.b.c"], True), ["c.b.a", "a.b.c"]) == [True, False]


def test_search(spark, points):
    index = tables.index(points, 1)
    names = lambda df: sorted(r.Path for r in df.collect())
    assert names(search.find(index, "mill.*.motor.*", "2021-07-05")) == ["mill.line7.motor.rpm"]
    assert names(search.find(index, "*.line[67].{motor,pump}.rpm")) == ["mill.line7.motor.rpm"]
    assert names(search.find(index, "mill.*.")) == ["mill.line7."]
    assert names(search.find(index, "mill.line7.motor.rpm", "2021-07-06")) == []
    found = search.find_tags(tables.tagged(points, 1), {"__name__": "motor.rpm", "site": "north"})
    assert names(search.fetch(points, found, 0, 2**32)) == ["motor.rpm?line=l7&site=north"]


def test_search_over_written_tables(spark, tmp_path, points):
    """A lookup in the stored tag table and points reads one month's folders only."""
    every = points.unionByName(points.withColumn("Date", F.date_add("Date", 60)).withColumn("Time", F.col("Time") + 60 * 86400))
    storage.write_table(tables.tagged(every, 1), str(tmp_path / "tagged"), "tagged")
    storage.write_table(every, str(tmp_path / "points"), "points")
    tags = storage.read_days(spark, str(tmp_path / "tagged"), "2021-09-01", "2021-09-30")
    stored = storage.read_days(spark, str(tmp_path / "points"), "2021-09-01", "2021-09-30")
    found = search.fetch(stored, search.find_tags(tags, {"site": "north"}), 0, 2**32)
    assert [(r.Path, r.Time) for r in found.collect()] == [("motor.rpm?line=l7&site=north", 1625478300 + 60 * 86400)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(month") >= 2 and re.search(r"PushedFilters: \[[^\n]*Tag1", plan)


def test_fan_out(spark, tmp_path, points):
    land = tmp_path / "land"
    points.coalesce(1).write.parquet(str(land))
    sinks = [fanout.Sink("index", str(tmp_path / "index"), ttl=3600), fanout.Sink("tagged", str(tmp_path / "tagged")), fanout.Sink("points", str(tmp_path / "points"))]

    def run(version):
        stream = spark.readStream.schema(points.schema).parquet(str(land))
        q = fanout.fan_out(stream, sinks, str(tmp_path / "cp"), version, drops=str(tmp_path / "drops"), rules={"past": 90})
        q.awaitTermination(120)
        assert q.exception() is None

    run(1000)
    assert not list((tmp_path / "index").glob("batch=*"))  # mill.* is older than 90 s at its reception
    points.withColumn("Timestamp", F.col("Time")).coalesce(1).write.mode("append").parquet(str(land))
    run(2000)
    points.withColumn("Timestamp", F.col("Time")).coalesce(1).write.mode("append").parquet(str(land))
    run(2500)  # known keys
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == 7 and {r.Version for r in index.collect()} == {2000}
    points.withColumn("Timestamp", F.col("Time")).coalesce(1).write.mode("append").parquet(str(land))
    run(6000)  # expired
    assert spark.read.parquet(str(tmp_path / "index")).where("Version = 6000").count() == 7
    assert spark.read.parquet(str(tmp_path / "drops")).count() > 0
    # a batch that runs again replaces itself
    fanout.write_batch(points.withColumn("Timestamp", F.col("Time")), 3, sinks, 6000)
    assert spark.read.parquet(str(tmp_path / "index")).where("Version = 6000").count() == 7


def test_known_keys_are_tidied(spark, tmp_path, points):
    """Days past the ttl go, a finished day's batches become one folder, and both leave the results as they were."""
    day = fanout.DAY
    sink = fanout.Sink("series", str(tmp_path / "series"), ttl=2 * day)
    at = lambda i: points.withColumn("Path", F.concat("Path", F.lit(f".{i}")))
    times = [10 * day + 5, 10 * day + 50, 10 * day + 500, 11 * day + 5, 11 * day + 6, 13 * day]
    for i, now in enumerate(times):
        fanout.write_batch(at(min(i, 4)), i, [sink], now)
        if i == 3:  # run again, after its day began: neither twice nor lost
            fanout.write_batch(at(3), 3, [sink], now)
    # the last batch comes after the keys of day 10 expired, but not those of day 11
    got = spark.read.parquet(sink.path)
    assert {r["batch"]: r["count"] for r in got.groupBy("batch").count().collect()} == {i: 1 for i in range(5)}
    folders = sorted(p.name for p in (tmp_path / "series_keys").glob("day=*"))
    assert folders == ["day=11"]
    assert len([p for p in (tmp_path / "series_keys" / "day=11").glob("batch=*")]) == 1
    fanout.write_batch(at(0), 9, [sink], times[-1] + 1)
    assert spark.read.parquet(sink.path).where("batch = 9").count() == 1
    keys = fanout.KnownKeys(points, str(tmp_path / "series_keys"), ("Date", "Path"))
    assert keys.count() == 3 * 4
    keys.clear()
    assert keys.count() == 0
    fanout.write_batch(at(0), 10, [sink], times[-1] + 2)
    assert spark.read.parquet(sink.path).where("batch = 10").count() == 1


def test_tree_of_dump(spark):
    lines = ["a.b.c\t1\t2\t2020-03-17\tx", "a.b.c\t1\t2\t2020-01-31", "a.d\t1\t2\t2020-02-01", "short\t1", "solo\t1\t2\tno date", ""]
    got = sorted((r.path, str(r.month), r.level) for r in tables.tree_of_dump(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert got == [("a.", "2020-01-01", 1), ("a.b.", "2020-01-01", 2), ("a.b.c", "2020-01-01", 3), ("a.d", "2020-02-01", 2)]


CONFIG = """
[common]
metric-prefix = "own"
metric-endpoint = "local"
[data]
path = "{root}"
utc-date = true
chunk-auto-interval = "1:2s"
[tcp]
drop-past = "1h"
[udp]
enabled = false
[grpc]
enabled = true
[convert-to-tagged]
enabled = true
separator = "."
templates = ["old.* .site.measurement*"]
[upload.p]
type = "points"
zero-timestamp = true
ignored-patterns = ["mill.*.noise"]
compression = "lz4"
[upload.i]
type = "index"
disable-daily-index = true
[upload.t]
type = "tagged"
ignored-tagged-metrics = ["motor.rpm"]
"""


@pytest.mark.parametrize("stream", [False, True])
def test_run_from_configuration(spark, tmp_path, stream):
    """All receivers that are enabled, their drop rules and templates, into all tables; counters come back as points."""
    for kind in ("tcp", "udp", "pickle", "grpc"):
        (tmp_path / kind).mkdir()
    now = 1625480000
    (tmp_path / "tcp" / "a").write_text("\n".join([*LINES, "mill.a.noise 1 1625479000", "old.north.oil.temp 60 1625479000", "late.one 1 1625470000", "bad", "cut.off 1"]))
    (tmp_path / "udp" / "a").write_text("off.because.disabled 1 1625479000\n")
    (tmp_path / "grpc" / "a").write_bytes(binary.put_payload([("motor.rpm;line=l9", [(1625479000, 4.0)])]))
    run = pipeline.build(spark, config.parse(CONFIG.replace("{root}", str(tmp_path))), stream, now)
    assert run.trigger == {"processingTime": "2000 milliseconds"}
    if stream:
        q = run.start({"processingTime": "1 second"})
        run.confirm()
        assert q.exception() is None and q.isActive
        run.stop()
        assert not q.isActive
    else:
        run.once(0, now)
    read = lambda name: spark.read.parquet(f"{tmp_path}/tables/{name}")
    own = [r.Path for r in read("p").where("Path LIKE 'own.%'").collect()]
    assert len(own) == (10 if stream else 0)  # the counters came back
    paths = sorted(r.Path for r in read("p").where("NOT Path LIKE 'own.%'").collect())
    assert paths == sorted(["mill.line7.motor.rpm"] * 2 + ["motor.rpm?line=l7&site=north", "motor.rpm?line=l9", "oil.temp?site=north", "ofen.gr%C3%B6%C3%9Fe?alt=ja"] + [p for p in paths if p.startswith("odd_tags")])
    assert len(paths) == 7 and {r.Timestamp for r in read("p").collect()} == {0}
    assert any(".lz4" in f for f in read("p").inputFiles()) and not any(".lz4" in f for f in read("i").inputFiles())
    assert {r.Date for r in read("i").collect()} == {TREE} and read("i").where("Path = 'mill.a.noise'").count() == 1
    assert [r.Tag1 for r in read("t").where("Path LIKE 'motor.rpm%l9'").collect()] == ["__name__=motor.rpm"]
    assert [r.Path for r in spark.read.parquet(f"{tmp_path}/dropped").collect()] == ["late.one"]
    assert pipeline.dropped_lately(spark, str(tmp_path), "tcp").first().line == "tcp/late.one/1625470000/1.0"
    assert spark.read.parquet(f"{tmp_path}/errors").count() == 1
    counters = {x.split()[0]: float(x.split()[1]) for p in (tmp_path / "tcp").glob("metrics-*") for x in p.read_text().splitlines()}
    assert counters == {f"own.{k}": v for k, v in {
        "tcp.metricsReceived": 7, "tcp.errors": 1, "tcp.pastDropped": 1, "tcp.futureDropped": 0, "tcp.tooLongDropped": 0,
        "grpc.metricsReceived": 1, "grpc.errors": 0, "grpc.pastDropped": 0, "grpc.futureDropped": 0, "grpc.tooLongDropped": 0,
    }.items()}
    run.stop()


def test_counters_are_sent(spark):
    import socket

    lines = [f"own.m{i} {i} 5" for i in range(300)]
    blocks = list(metrics.chunks(lines, 1000))
    assert max(map(len, blocks)) <= 1000 and b"".join(blocks).decode().splitlines() == lines and all(b.endswith(b"\n") for b in blocks)
    assert list(metrics.chunks(["x" * 50], 10)) == [b"x" * 50 + b"\n"] and list(metrics.chunks([], 10)) == []
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(10)
        metrics.deliver(spark, lines[:2], f"udp://127.0.0.1:{s.getsockname()[1]}", "")
        assert s.recv(2000) == b"own.m0 0 5\nown.m1 1 5\n"
    with pytest.raises(ValueError):
        metrics.deliver(spark, lines, "pigeon://x", "")


def test_checkpoints_need_a_shared_folder():
    from types import SimpleNamespace as Any

    from seriesmill import session

    unset = Any(isEmpty=lambda: True)
    cluster = Any(sparkContext=Any(master="spark://host:7077", _jsc=Any(sc=lambda: Any(getCheckpointDir=lambda: unset))), conf=Any(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        session.shared_folder(cluster)


def test_counters(spark, points):
    rows, seen = metrics.counted(points.withColumn("reason", F.when(F.col("Path").like("mill%"), "past")))
    rows.write.format("noop").mode("overwrite").save()
    assert metrics.metric_rows(seen.get, "p", "tcp", 5)[2] == ("p.tcp.received", 5.0, 5)
    assert seen.get["pastDropped"] == 2


def test_config(tmp_path, capsys):
    assert config.duration("1m0s") == 60 and config.duration("1h30m5.5s") == 5405.5 and config.duration("0") == 0 and config.duration("-250ms") == -0.25
    assert config.size("512m") == 512 << 20 and config.size("7") == 7
    auto = config.AutoInterval.parse("5:10s, 1:5s,20:60s", 1)
    assert [auto.interval(n) for n in (0, 1, 5, 19, 20)] == [1, 5, 10, 10, 60]
    for bad, call in (("1x", config.duration), ("", config.duration), ("-1", config.size), ("zip", config.compression), ("5", config.AutoInterval.parse)):
        with pytest.raises(ValueError):
            call(bad)
    c = config.parse('[tcp]\ndrop-past = "1h"\n[upload.i]\ntype = "index"\n')
    assert c.drop_rules("tcp") == {"future": 0, "past": 3600, "longest": 0} and c.uploads["i"]["cache-ttl"] == 43200 and "{" not in c.sections["common"]["metric-prefix"]
    for bad in ("[tcp]\nnope = 1\n", "[nope]\n", '[upload.x]\ntype = "nope"\n'):
        with pytest.raises(ValueError):
            config.parse(bad)
    config.parse("[tcp]\nnope = 1\n", exact=False)
    main(["--print-config"])
    config.parse(capsys.readouterr().out)
    damaged, good = tmp_path / "default.1", tmp_path / "default.2.lz4"
    damaged.write_bytes(binary.put_rows([("a", 1.0, 5, 0, 1)]) + b"\x09abc")
    main(["--recover", str(damaged), str(good)])
    main(["--cat", str(good)])
    assert capsys.readouterr().out == "a\t1.0\t5\t1970-01-01\t1\n"
