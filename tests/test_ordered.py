"""Ordered operators agree with brute force, whatever the slices."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from tests.conftest import raw_row
from netsilt.operators import anomaly, cascade, classify
from netsilt.operators.ordered import over_previous_rows, running, running_total
from netsilt.schema import RAW_LOG
from pyspark.sql import functions as F

T0 = datetime(2025, 1, 1)
TEXTS = [
    ("BGP neighbor down", "%BGP-3"), ("Interface Ethernet0/1 link down", "%LINK-3"), ("High CPU", "%CPU-1"),
    ("Port scan from 10.1.1.1", "x"), ("DNS spike", "dns flood"), ("nothing", "to see"),
]


def skewed(n=400, seed=5):
    """A device with most of the logs, many equal time stamps, some missing metrics."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.6 else f"dev-{rng.randrange(8)}"
        at = T0 if rng.random() < 0.2 else T0 + timedelta(seconds=rng.randrange(0, 40_000))
        text, raw = TEXTS[rng.randrange(len(TEXTS))]
        rows.append(raw_row(f"L{i:05d}", source, "api", "ERROR", text, raw, rng.randrange(100), rng.randrange(100),
                            rng.randrange(5), at))
    return rows


@pytest.fixture(scope="module")
def rows():
    return skewed()


@pytest.fixture(scope="module")
def logs(spark, rows):
    return classify.classify(spark.createDataFrame(rows, RAW_LOG).repartition(5)).persist()


def table(df, key, *cols):
    return {tuple(r[k] for k in key): tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("width", [1, 7, 1000])  # each number alone, some, all in one slice
def test_running_total(spark, width):
    rng = random.Random(1)
    data = [("a" if i % 3 else None if i % 7 == 1 else f"k{i % 7}", rng.randrange(-20, 50), i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(data, "k string, x int, id int, v long").repartition(6)
    out = running_total(df, ["k"], ["x", "id"], "v", "total", width)
    assert out.columns == [*df.columns, "total"]
    want, sums = {}, defaultdict(int)
    for k, x, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        sums[k] += v
        want[(i,)] = (sums[k],)
    assert table(out, ["id"], "total") == want


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_last_and_following(spark, width):
    rng = random.Random(3)
    data = [(f"k{i % 3}", rng.randrange(60), i, i if rng.random() < 0.2 else None) for i in range(300)]
    out = running(spark.createDataFrame(data, "k string, x int, id int, v int").repartition(5), ["k"], ["x", "id"],
                  last={"before": "v"}, following={"after": "v"}, slice_width=width)
    want = {}
    for key in ("k0", "k1", "k2"):
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(mine):
            before = [s[3] for s in mine[:i + 1] if s[3] is not None]
            after = [s[3] for s in mine[i:] if s[3] is not None]
            want[(r[2],)] = (before[-1] if before else None, after[0] if after else None)
    assert table(out, ["id"], "before", "after") == want


@pytest.mark.parametrize("block,width", [(20, 1), (33, 9), (1000, 1000)])
def test_previous_rows(spark, block, width):
    rng = random.Random(2)
    data = [("a" if i % 3 else f"k{i % 7}", rng.randrange(50), i, float(rng.randrange(10))) for i in range(500)]
    df = spark.createDataFrame(data, "k string, x int, id int, v double").repartition(6)
    out = over_previous_rows(df, ["k"], ["x", "id"], 20, {"n": F.count("v"), "s": F.sum("v")}, width, block)
    want, seen = {}, defaultdict(list)
    for k, x, i, v in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        seen[k].append(v)
        want[(i,)] = (len(seen[k][-20:]), sum(seen[k][-20:]))
    assert table(out, ["id"], "n", "s") == want


MINUTE = 60_000_000
SLICED = {"slice_width": 90 * MINUTE, "block_rows": 128}


@pytest.mark.parametrize("options", [{}, SLICED])
def test_zscores(logs, rows, options):
    got = table(anomaly.rolling_zscore(logs, **options), ["log_id", "metric"], "z_score", "samples")
    history = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        for m, v in r[10].items():
            h = history[(r[2], m)]
            h.append(v)
            last = np.array(h[-100:])
            std = last.std()
            z = 0.0 if len(last) < 10 or std < 1e-6 else abs((v - last.mean()) / std)
            z_got, n_got = got[(r[0], m)]
            assert n_got == len(last) and z_got == pytest.approx(z, abs=1e-9)


@pytest.mark.parametrize("options", [{}, {"slice_width": 20 * MINUTE}])
def test_bursts(logs, rows, options):
    window = timedelta(minutes=30)
    got = table(anomaly.burst_ratio(logs, "source", window, **options), ["log_id"], "current_count", "burst_ratio", "is_burst")
    seen = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        t = seen[r[2]]
        t.append(r[1])
        now = r[1]
        six = [x for x in t if x > now - 6 * window]
        current = len([x for x in six if x > now - window])
        base = max((len(six) - current) / 5, 1.0)
        ratio = current / base if len(six) >= 5 else 1.0
        assert got[(r[0],)] == (current, pytest.approx(round(ratio, 2), abs=0.011), len(six) >= 5 and ratio >= 3)
    assert any(v[2] for v in got.values())


@pytest.mark.parametrize("options", [{}, {"slice_width": 45 * MINUTE}])
def test_cascades(logs, rows, options, monkeypatch):
    monkeypatch.setattr(cascade, "EDGE_BLOCK", 7)
    from netsilt.rules import CASCADE_RULES

    category = table(logs, ["log_id"], "category")
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {}
    for i, root in enumerate(ordered):
        for cause, effect, _, confidence in CASCADE_RULES:
            if category[(root[0],)][0] != cause:
                continue
            related = [e for e in ordered[i + 1:] if category[(e[0],)][0] == effect and e[1] - root[1] <= timedelta(hours=1)]
            if related:
                want[(root[0], effect)] = (len(related), related[0][0], related[-1][0], confidence,
                                           [e[0] for e in related], {root[2], *(e[2] for e in related)})
    got = table(cascade.cascade_correlations(logs, **options), ["root_event_id", "effect_category"],
                "related_count", "first_effect_id", "last_effect_id", "confidence")
    assert got == {k: v[:4] for k, v in want.items()} and len(got) > 20
    edges = cascade.cascade_edges(logs, **options).persist()
    listed = defaultdict(list)
    for r in sorted(edges.collect(), key=lambda r: r["position"]):
        listed[r["correlation_id"]].append(r["effect_event_id"])
    assert sorted(map(tuple, listed.values())) == sorted(tuple(v[4]) for v in want.values())
    sources = defaultdict(set)
    monkeypatch.setattr(cascade, "FAN", 2)
    monkeypatch.setattr(cascade, "LEVELS", 4)
    by_blocks = cascade.cascade_sources(logs, **options)
    assert sorted(map(tuple, by_blocks.collect())) == sorted(map(tuple, cascade.affected_sources(edges).collect()))
    for r in cascade.affected_sources(edges).collect():
        sources[r["correlation_id"]].add(r["source"])
    assert sorted(map(sorted, sources.values())) == sorted(sorted(v[5]) for v in want.values())
    edges.unpersist()


def test_devices_of_a_cascade_are_made_once(logs, monkeypatch):
    """Blocks give each pair of run and device one time, so nothing brings equal pairs together by a shuffle of all pairs."""
    doubled = [*cascade.rules.CASCADE_RULES, ("INTERFACE", "BGP", "a second hypothesis", 0.5)]
    for block, fan, levels in ((1, 2, 3), (3, 2, 2), (256, 8, 4)):
        monkeypatch.setattr(cascade, "EDGE_BLOCK", block)
        monkeypatch.setattr(cascade, "FAN", fan)
        monkeypatch.setattr(cascade, "LEVELS", levels)
        found = cascade.cascade_sources(logs, cascade_rules=doubled, slice_width=45 * MINUTE)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [correlation_id" not in plan and "Deduplicate" not in plan
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, cascade.affected_sources(cascade.cascade_edges(logs)).collect()))


def shuffled(df) -> list[int]:
    """Rows that each exchange of the plan wrote."""
    def under(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        own = [node.metrics().apply("shuffleRecordsWritten").value()] if node.nodeName() == "Exchange" else []
        return own + [n for c in children for n in under(c)]

    return under(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("what", ["edges", "stored", "sources"])
def test_dense_cascades_shuffle_logs_not_pairs(spark, what):
    """A run of 4,000 effects is shuffled as a whole, not once per 256 effects; its id is made behind the shuffle."""
    at = [T0 + timedelta(milliseconds=k) for k in range(500)] + [T0 + timedelta(minutes=1, milliseconds=500 * k) for k in range(4000)]
    dense = spark.createDataFrame(
        [(f"L{k:05d}", t, *((f"r{k}", "DNS") if k < 500 else (f"d{k % 7}", "SECURITY"))) for k, t in enumerate(at)],
        "log_id string, timestamp timestamp, source string, category string")
    only = [("DNS", "SECURITY", "h", 0.5)]
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        if what == "edges":
            made, want = cascade.cascade_edges(dense, cascade_rules=only), 500 * 4000
        elif what == "stored":
            found = cascade.fresh_runs(dense.withColumn("fresh", F.lit(True)), timedelta(hours=1), only)
            made, want = cascade.stored_edges(found.withColumn("batch", F.lit(0)), only), 500 * 4000
        else:
            made, want = cascade.cascade_sources(dense, cascade_rules=only), 500 * (1 + 7)
        counted = made.agg(F.count("*").alias("n"), F.max("correlation_id"))
        assert counted.collect()[0]["n"] == want
        assert 0 < max(shuffled(counted)) <= 4000 + 4 * 500      # effects, and both ends of each window in two orders
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert not any("md5" in line for line in plan[plan.index("SortMergeJoin"):].splitlines())
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)


def test_building_a_plan_runs_no_job(spark, logs):
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    anomaly.anomaly_scores(logs)
    cascade.cascade_correlations(logs)
    assert not status.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_logs_without_a_time_stay_out(spark):
    rows = [raw_row(f"L{i}", "d", "api", "INFO", "x", "y", 10 + i, 1, 1, T0 + timedelta(minutes=i)) for i in range(12)]
    lost = raw_row("LOST", "d", "api", "INFO", "x", "y", 99, 1, 1, None)
    out = anomaly.rolling_zscore(spark.createDataFrame([*rows, lost], RAW_LOG)).filter("metric = 'cpu_usage'").collect()
    assert len(out) == 12 and max(r["samples"] for r in out) == 12


@pytest.mark.parametrize("whole", [0, 100, 1000])  # all keys cut into blocks, the large one only, none
def test_previous_rows_of_small_and_large_keys(spark, whole):
    rng = random.Random(4)
    data = [("a" if i % 3 else None if i % 7 == 1 else f"k{i % 7}", rng.randrange(50), i, float(rng.randrange(10))) for i in range(500)]
    df = spark.createDataFrame(data, "k string, x int, id int, v double").repartition(6)
    out = over_previous_rows(df, ["k"], ["x", "id"], 20, {"n": F.count("v"), "s": F.sum("v")}, 9, 33, whole)
    assert out.columns == [*df.columns, "n", "s"]
    want, seen = {}, defaultdict(list)
    for k, x, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        seen[k].append(v)
        want[(i,)] = (len(seen[k][-20:]), sum(seen[k][-20:]))
    assert out.count() == len(data) and table(out, ["id"], "n", "s") == want


@pytest.mark.parametrize("width", [1, 3 * 60 * MINUTE])
def test_window_counts_keep_columns_and_run_no_probes(spark, width):
    """Borders are open on the left; logs at one time count in order of their ids; one row per log is shuffled, once."""
    rng = random.Random(6)
    data = [(f"L{i:03d}", rng.choice("ab"), T0 + timedelta(minutes=rng.randrange(400)), i) for i in range(300)]
    df = spark.createDataFrame([*data, ("N", "a", None, 0)], "log_id string, source string, timestamp timestamp, x int")
    out = anomaly.window_counts(df, "source", timedelta(minutes=30), (1, 2), ("x",), slice_width=width)
    assert str(out._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1
    want = {}
    for i, s, t, x in data:
        back = [t - u for j, o, u, _ in data if o == s and (u, j) <= (t, i)]
        want[(i,)] = (s, x, *[sum(b < timedelta(minutes=30 * n) for b in back) for n in (1, 2)])
    assert table(out, ["log_id"], "source", "x", "n_1", "n_2") == want


def test_anomaly_scores_of_logs_without_a_time(spark):
    rows = [raw_row(f"L{i}", "d", "api", "ERROR", "login failed", "x", 1, 1, 0, None if i == 3 else T0 + timedelta(minutes=i)) for i in range(5)]
    found = anomaly.anomaly_scores(classify.classify(spark.createDataFrame(rows, RAW_LOG)))
    assert sorted(r["log_id"] for r in found.collect()) == ["L0", "L1", "L2", "L3", "L4"]
