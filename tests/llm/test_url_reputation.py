"""Url parts, rules, and reputations against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netsilt.llm import url_reputation as U

URLS = [
    (None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://", "", ""), ("HTTP://A.B.Com", "a.b.com", ""),
    ("https://A.com/P/Q?x=1#y", "a.com", "/P/Q"), ("x://h?q=/a", "h", ""), ("x://h#/a", "h", ""), ("a://b://c/d", "b:", "//c/d"),
    ("http://u@h.de:80/é#", "u@h.de:80", "/é"), ("http://h/a\nb?c", "h", "/a\nb"), ("http://É.com/", "É.com", "/"),
]


def test_parts(spark):
    got = spark.createDataFrame([(u,) for u, _, _ in URLS], "url string").select("url", U.host_of(F.col("url")), U.path_of(F.col("url"))).collect()
    assert [tuple(r) for r in got] == URLS


DOMAINS = {"www.a.co.uk": ("a.co.uk", "co.uk"), "a.com": ("a.com", "com"), "x.y.a.com:80": ("a.com", "com"), "me@b.a.com.": ("a.com", "com"),
           "10.0.0.1:8080": ("10.0.0.1", ""), "[::1]": ("[::1]", ""), "localhost": ("localhost", ""), "": ("", ""), "co.uk": ("co.uk", "co.uk")}


def test_domains(spark):
    df = spark.createDataFrame([(h,) for h in DOMAINS], "host string")
    got = df.select("host", *U.domain_parts(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == DOMAINS


def test_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    cases = {("example.net", "/en/1"): "example.net/en/", ("a.example.net", "/en/"): "example.net/en/", ("badexample.net", "/en/"): "net/",
             ("example.net", ""): None, ("net", "/"): "net/", ("com", "/de/"): None, ("m.example.com", "/de/x"): "example.com/de/",
             ("example.com", "/en/de/"): None, ("x.org", "/fr/"): "org/fr/", ("org", "/fr"): None, ("a.net:80", "/"): None}
    df = spark.createDataFrame(list(cases), "host string, path string")
    got = df.select("host", "path", U.matched_rule(F.col("host"), F.col("path"), rules)["rule"]).collect()
    assert {(r[0], r[1]): r[2] for r in got} == cases
    with pytest.raises(ValueError):
        U.matched_rule(F.col("host"), F.col("path"), [("allow", f"h{k}/") for k in range(U.MAX_RULES + 1)])


def brute_force(hosts):
    """Posterior mean and deviation of (host, domain, suffix, n, bad) rows, level by level."""
    def level(children, mean_of):
        over = sum(round(((b - n * mean_of[p]) ** 2 - n * mean_of[p] * (1 - mean_of[p])) * 1e6) for p, n, b in children.values())
        most = sum(round(n * mean_of[p] * (1 - mean_of[p]) * (n - 1) * 1e6) for p, n, b in children.values())
        w = 1 / min(max(over / most if most else 1e-4, 1e-4), 0.5) - 1
        return {k: (b + w * mean_of[p], n - b + w * (1 - mean_of[p])) for k, (p, n, b) in children.items()}
    suffix, domain = {}, {}
    for h, d, s, n, b in hosts:
        for table, key, parent in ((suffix, s, ""), (domain, d, s)):
            _, x, y = table.get(key, (parent, 0, 0))
            table[key] = (parent, x + n, y + b)
    mean = {"": (sum(r[4] for r in hosts) + 1) / (sum(r[3] for r in hosts) + 2)}
    for table in (suffix, domain):
        mean = {k: a / (a + b) for k, (a, b) in level(table, mean).items()}
    out = level({h: (d, n, b) for h, d, s, n, b in hosts}, mean)
    return {h: (a / (a + b), math.sqrt(a * b / (a + b) ** 2 / (a + b + 1))) for h, (a, b) in out.items()}


def test_reputations(spark, monkeypatch):
    monkeypatch.setattr(U, "HOT_SHARE", 4)      # both ways of looking up
    rng = random.Random(5)
    rows = []
    for s in ("com", "org", "co.uk"):
        for d in range(6):
            rate = rng.random()
            for k in range(rng.randrange(1, 8)):
                n = rng.choice([0, 1, 5, 40])
                rows.append((f"h{k}.d{d}.{s}", f"d{d}.{s}", s, n, sum(rng.random() < rate for _ in range(n))))
    df = spark.createDataFrame([(h, n + rng.randrange(1, 500), n, b) for h, _, _, n, b in rows], "host string, rows long, n long, bad long")
    got, want = {r.host: (r.mean, r.deviation) for r in U.reputations(df).collect()}, brute_force(rows)
    assert got.keys() == want.keys()
    for h, pair in want.items():
        assert got[h] == pytest.approx(pair, rel=1e-6)


def test_bad_hosts_are_blocked(spark):
    """A host of bad pages goes; its sister without labels keeps the benefit of the doubt; rules come first."""
    rows, labels = [], []
    for k in range(4000):
        host = ["spam.bad.com", "fine.good.com", "other.bad.com", "x.good.com"][min(k % 7, 3)]
        rows.append((k, f"http://{host}/{'en' if k % 2 else 'de'}/{k}", "clash", "clash"))
        if host != "other.bad.com" and k % 3 == 0:
            labels.append((k, int(host == "spam.bad.com")))
    rows += [(None, "http://spam.bad.com/", "a", "b"), (8000, None, "a", "b"), (9999, "http://new.example/", "a", "b")]
    labels += [(None, 1), (5, None), (7, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, bound string")
    outcomes = spark.createDataFrame(labels, "page_id long, bad int")
    got = U.url_verdicts(pages, outcomes, [("allow", "bad.com/en/")]).collect()
    assert len(got) == len(rows)
    for r in got:
        allowed = r.host != "spam.bad.com" or r.path.startswith("/en/")
        if r.host != "other.bad.com":
            assert r.verdict == ("allow" if allowed else "block"), r
        assert (r.rule == "bad.com/en/") == (r.host.endswith("bad.com") and r.path.startswith("/en/"))


def test_no_labels_and_empty(spark, messy):
    pages = messy.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "source", "row", "key")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = U.url_verdicts(pages, none).collect()
    assert len(got) == messy.count() and {r.verdict for r in got} == {"allow"}
    assert U.url_verdicts(pages.limit(0), none).collect() == []


def test_no_python_in_the_plan(spark):
    from netsilt.llm.queries import op12_url_reputation
    plan = op12_url_reputation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
