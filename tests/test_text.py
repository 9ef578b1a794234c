"""Patterns against Python's ``re`` on mixed texts; single columns."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from netsilt import rules
from netsilt.functions import text as X
from netsilt.functions.columns import bucket, fixed, lookup, rounded, sql_literal
from pyspark.sql import functions as F

PIECES = [
    "10.0.0.1", "300.1.2.3", "1.2.3.4.5", "é10.0.0.1", "GigabitEthernet0/0/1", "vlan12", "%BGP-3-X:", "%asa_x:", "%LINK", ":22",
    ":443 ", ":99999", "port scan", "scan the port", "a.b.example.com", "Example.ORG", "x.comx", "deadbeef", "D41D8CD98F00B204",
    "a" * 32, "B" * 64, "c" * 65, "\n", "\r", " ", "\t", " ", " ", "down", "interface", "ünïcode", "ſcan", "İDS",
    "IOS-XE 17.3", "nx-os 9.1", "v1.2.3", "asa 9", "auth.fail", "failed-login", "dns", "AMP", "٣٤٥٦", "<34>", "cpu utilization 8", "9", "0",
]


def texts(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def test_matches_agree_with_python(spark):
    patterns = [r[0] for r in rules.CLASSIFICATION_RULES] + [p for _, p in rules.THREAT_PATTERNS]
    patterns += [p for _, p in rules.SYSLOG_COMPONENTS]
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    got = df.select("t", *[F.col("t").rlike(X.rx(p, True)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    odd = [(p, r["t"]) for r in got for i, p in enumerate(patterns) if r[f"p{i}"] != bool(re.search(p, r["t"], re.I))]
    assert odd == []


def test_extractions_agree_with_python(spark):
    patterns = [(rules.IPV4, False), (rules.DOMAIN, True), (rules.FILE_HASH, True), (rules.NAMED_INTERFACE, True)]
    df = spark.createDataFrame([(t,) for t in texts(seed=4)], "t string")
    got = df.select("t", *[X.find_all("t", p, 0, ci).alias(f"p{i}") for i, (p, ci) in enumerate(patterns)]).collect()
    odd = [(p, r["t"], r[f"p{i}"]) for r in got for i, (p, ci) in enumerate(patterns)
           if r[f"p{i}"] != [m.group(0) for m in re.finditer(p, r["t"], re.I if ci else 0)]]
    assert odd == []


def test_version(spark):
    df = spark.createDataFrame([("", "ran IOS 15.2 on ASA 9.1"), ("9.9", "IOS 15.2"), (None, "v1.2.3"), ("", "none")],
                               "version string, t string")
    got = [r[0] for r in df.select(X.software_version("version", "t")).collect()]
    assert got == ["IOS 15.2", "9.9", "v1.2.3", "Unknown"]


def test_bucket_and_lookup(spark):
    df = spark.createDataFrame([(0.85, "a"), (0.8499, "b"), (0.1, None)], "s double, k string")
    got = [tuple(r) for r in df.select(bucket("s", [("HI", 0.85), ("MID", 0.5)], "LO"), lookup({"a": 1}, "k", 7)).collect()]
    assert got == [("HI", 1), ("MID", 7), ("LO", 7)]


def test_rounding_agrees_with_python(spark):
    rng = random.Random(8)
    values = [rng.randrange(-4000, 4000) / d for d in (1, 2, 8, 16, 100, 1000, 10_000, 3, 7) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", *[rounded("v", n).alias(f"r{n}") for n in (1, 2, 3)], fixed("v", 0).alias("f0"),
                    fixed("v", 1).alias("f1"), fixed("v", 3).alias("f3")).collect()
    for r in got:
        v = r["v"]
        assert (r["r1"], r["r2"], r["r3"]) == (round(v, 1), round(v, 2), round(v, 3))
        assert [float(r[f"f{n}"]) for n in (0, 1, 3)] == [float(f"{v:.{n}f}") for n in (0, 1, 3)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=8), min_size=1, max_size=4))
def test_sql_literal_round_trip(spark, values):
    values = [v for v in values if not any(0xD800 <= ord(c) <= 0xDFFF for c in v)] or ["x"]
    assert spark.range(1).select(F.expr(sql_literal(values)).alias("v")).first()["v"] == values


def test_needed_words():
    assert X.needed_words(r"%BGP|bgp.neighbor|hold.timer") == ["%bgp", "neighbor", "timer"]
    assert X.needed_words(r"colou?r|ab{2}c|[x\]y]lan|cpu\d*9") == ["colo", "a", "lan", "cpu"]
    assert [X.needed_words(p) for p in (r"(a)b", r"\d+|ab", r"\x41bc", "straße", "")] == [None] * 5


def test_patterns_behind_needed_words_find_the_same(spark):
    """Also in letters that only match ASCII ones when case is ignored: long s, Kelvin sign, dotless and dotted i."""
    patterns = [r[0] for r in rules.CLASSIFICATION_RULES] + [p for _, p in rules.THREAT_PATTERNS]
    words = "BGP Neighbor hold timer voice QUEUE ids voıce İDS ſnort %LINK linK down port scan ſcan brute-force auth failed".split()
    rng = random.Random(5)
    texts = [" ".join(rng.choices(words, k=rng.randrange(5))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("lower", F.lower("t"))
    df = df.withColumn("plain", X.plain_text("t", "lower"))
    got = df.select("plain", X.first_match("t", patterns).alias("all"), X.first_match("t", patterns, plain="plain").alias("some")).collect()
    assert [r["some"] for r in got] == [r["all"] for r in got]
    assert any(r["plain"] is None and r["all"] for r in got) and any(r["plain"] and r["all"] for r in got)
