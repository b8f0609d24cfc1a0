import random
import re
import string
import urllib.parse

import pytest
from pyspark.sql import functions as F

from seriesmill.functions import ancestor_prefixes, canonical_path, canonical_tags, path_escape, path_level, query_escape, reverse_path, squeeze_dots, tag_list, unescape
from seriesmill.functions import numbers, rules
from seriesmill.functions.paths import tag_map
from seriesmill.functions.templates import Template, apply_templates

CANONICAL = [
    (";room=3;floor=1", None),
    ("boiler;unit=kelvin;broken;site=north", None),
    ("boiler.inlet", "boiler.inlet"),
    ("boiler.inlet;room=3;floor=1.5;room=7", "boiler.inlet?floor=1.5&room=7"),
    ("boiler;z=9;y=8;x=7", "boiler?x=7&y=8&z=9"),
    ("boiler;p=q;p=-;p2=1;p=5;p=60", "boiler?p=60&p2=1"),
    ("plant/north_wing.boiler;p=1", "plant/north_wing.boiler?p=1"),
    ("ofen.größe", "ofen.größe"),
    ("ofen.größe;alt=ja", "ofen.gr%C3%B6%C3%9Fe?alt=ja"),
    ("ofen,2;alt=ja", "ofen,2?alt=ja"),
    ("why?so", "why?so"),
    ("why?so;alt=ja", "why%3Fso?alt=ja"),
    ("ofen;alt=ja?nein", "ofen?alt=ja%3Fnein"),
    ("x;k=", "x?k="),
    ("x;", None),
    ("x;=v", None),
    ("x;k=v=w", "x?k=v%3Dw"),
    (None, None),
    ("", ""),
]


def test_canonical_tags(column):
    assert column(canonical_tags, [a for a, _ in CANONICAL]) == [b for _, b in CANONICAL]


def test_canonical_path(column):
    cases = [("a..b;k=v", "a.b?k=v"), ("a...b?k=1..2", "a.b?k=1.2"), ("x?b;c", "x?b;c"), ("bad;tag", "bad;tag"), (None, None), ("", ""), ("b;y=1;x=a b", "b?x=a+b&y=1")]
    assert column(canonical_path, [a for a, _ in cases]) == [b for _, b in cases]


def test_squeeze(column):
    cases = {"": "", "...": ".", "pump.flow": "pump.flow", "pump....flow.rate": "pump.flow.rate", "...pump..flow": ".pump.flow", "pump..": "pump."}
    assert column(squeeze_dots, list(cases)) == list(cases.values())


def test_reverse_level_prefixes(column):
    names = ["x.y.z", "alone", "..left.right", "", None]
    assert column(reverse_path, names) == ["z.y.x", "alone", "right.left..", "", None]
    assert column(path_level, names) == [3, 1, 4, 1, None]
    got = column(ancestor_prefixes, ["a.b.c", "one"])
    assert [[(x.Level, x.Path) for x in g] for g in got] == [[(1, "a."), (2, "a.b.")], []]


UNESCAPED = [
    ("", ""), ("flow", "flow"), ("m%33", "m3"), ("%66%6C%6f%77", "flow"), ("%7e", "~"), ("50%25", "50%"), ("50%", "50%"), ("%q", "%q"), ("%9", "%9"), ("x%2", "x%2"),
    ("7%2Fh%2", "7/h%2"), ("%xyz12", "%xyz12"), ("in+out", "in out"), ("p+%26+q", "p & q"), ("%C3%BCber", "über"), (None, None),
]


def test_unescape(column):
    assert column(unescape, [a for a, _ in UNESCAPED]) == [b for _, b in UNESCAPED]


def test_escapes_against_model(column):
    random.seed(5)
    texts = ["".join(random.choice(string.printable + "äж中🔒") for _ in range(random.randint(0, 20))) for _ in range(500)]
    want = [re.sub(r"%20", "+", urllib.parse.quote(t, safe="-_.~")) for t in texts]
    assert column(query_escape, texts) == want
    assert column(path_escape, texts) == [urllib.parse.quote(t, safe="-_.~$&+,/:;=@") for t in texts]
    assert column(lambda x: unescape(query_escape(x)), texts) == texts


def test_tag_list(column):
    cases = [
        ("pump.flow?line=7&site=north", ["__name__=pump.flow", "line=7", "site=north"]),
        ("a+b?x=1", ["__name__=a b", "x=1"]),
        ("n?k=%3A&bad&z=1", ["__name__=n", "k=:"]),
        ("plain.path", None), ("?k=v", None), (None, None),
    ]
    assert column(tag_list, [a for a, _ in cases]) == [b for _, b in cases]


TEMPLATES = [
    Template.parse(t)
    for t in ("*.rpm line.motor.measurement", "press.* .site.measurement* shift=late,plant=p9", "mill.fine.* ..roll.measurement*    plant=p8", ".measurement*")
]


def test_templates(column):
    cases = {
        "any.flow": "flow?crew=red&plant=p1",
        "l4.m2.rpm": "rpm?crew=red&line=l4&motor=m2&plant=p1",
        "press.north.oil.in.temp": "oil_in_temp?crew=red&plant=p9&shift=late&site=north",
        "mill.fine.r3.gap.mm": "gap_mm?crew=red&plant=p8&roll=r3",
        "single": "single",
        "tagged;k=v": "tagged?k=v",
    }
    made = lambda x: canonical_tags(apply_templates(x, TEMPLATES, "_", ["plant=p1", "crew=red"]))
    assert column(made, list(cases)) == list(cases.values())
    assert column(lambda x: apply_templates(x, TEMPLATES, "_", compat=True), ["single"]) == [""]
    with pytest.raises(ValueError):
        Template.parse("x.* measurement tag")


def test_tag_map(column):
    got = column(tag_map, ["pump.flow?line=7&site=north&line=8", "a+b?x=1%3D2", "plain", None])
    assert got == [{"__name__": "pump.flow", "line": "8", "site": "north"}, {"__name__": "a b", "x": "1=2"}, None, None]


def test_floats(column):
    assert column(numbers.is_number, [1.0, float("nan"), float("inf"), None], "double") == [True, False, True, False]
    texts = ["1", "-1.5e3", ".5", "5.", "1e400", "NaN", "inf", "-Infinity", "0x1p3", "42d", " 42", "", "1_0", None]
    assert column(numbers.parse_float, texts) == [1.0, -1500.0, 0.5, 5.0, None, None, float("inf"), float("-inf"), 8.0, None, None, None, None, None]


def test_numbers_and_days(column):
    assert column(numbers.wrap_u32, [-1, 4294967296, 5], "bigint") == [4294967295, 0, 5]
    assert column(numbers.seconds_of_ms, [1999, -1999], "bigint") == [1, -1]
    days = column(lambda x: numbers.local_day(x, "America/New_York"), [1710046800 - 1, 1710046800 + 5 * 3600, None], "bigint")
    assert [str(d) for d in days] == ["2024-03-09", "2024-03-10", "None"]
    assert str(column(numbers.utc_day, [-1], "bigint")[0]) == "1969-12-31"


def test_rules(column, spark):
    rows = spark.createDataFrame([(2, None, 9, 0), (1, r"\.sum$", 5, 0), (0, r"\.sum$", 3, 100)], "rule_no int, regexp string, precision int, age int")
    got = rules.read_rules(rows)
    assert column(lambda x: rules.series_step(x, got), ["a.sum", "b", None]) == [5, 9, 9]
    assert column(lambda x: rules.series_step(x, []), ["a.sum"]) == [None]
    many = spark.range(rules.MOST_RULES + 1).select(F.col("id").alias("rule_no"))
    with pytest.raises(ValueError):
        rules.read_rules(many)
