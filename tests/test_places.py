"""Ids that last: other splits, other partitions, streams, branches and restarts."""

import json
import random

import pytest
from netsilt.sources import places, readers
from netsilt.streaming import ingest, windows
from pyspark.sql import functions as F

SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def folder(spark, tmp_path):
    """Three files of lines of which many are equal, one of them with line ends of two bytes."""
    rng = random.Random(3)
    path = tmp_path / "in"
    path.mkdir()
    for k, end in enumerate(("\n", "\r\n", "\n")):
        lines = [rng.choice(["<13>same", "<13>ünequal " + "x" * rng.randrange(40), ""]) for _ in range(400)]
        (path / f"{k}.log").write_bytes((end.join(lines) + (end if k else "")).encode())
    return str(path)


def split_sizes(spark, sizes):
    before = spark.conf.get(SPLITS)
    try:
        for size in sizes:
            spark.conf.set(SPLITS, str(size))
            yield size
    finally:
        spark.conf.set(SPLITS, before)


def ids(logs):
    return sorted(r[0] for r in logs.select("log_id").collect())


def done(query):
    query.awaitTermination()
    assert query.exception() is None


def test_places_are_bytes(spark, folder):
    for _ in split_sizes(spark, ["128m", 1000, 97]):
        got = places.with_line_places(spark.read.text(f"{folder}/0.log")).collect()
        data = open(f"{folder}/0.log", "rb").read()
        for r in got:
            at = int(r[places.PLACE].rsplit(":", 1)[1])
            assert data[at:at + len(r.value.encode())] == r.value.encode()
        assert len({r[places.PLACE] for r in got}) == len(got) == 400


def test_splits_do_not_matter(spark, folder):
    found = [ids(readers.read_logs(spark, folder)) for _ in split_sizes(spark, ["128m", 3000, 211])]
    assert found[0] == found[1] == found[2] and len(set(found[0])) == len(found[0]) > 600


def test_branches_of_a_query_agree(spark, folder):
    logs = readers.read_logs(spark, folder).repartition(5)
    again = logs.select(F.col("log_id").alias("other"))
    assert logs.join(again, F.col("log_id") == F.col("other")).count() == logs.count()


def test_streams(spark, folder, tmp_path):
    batch = ids(readers.read_logs(spark, folder))
    done(ingest.append_to(ingest.syslog_stream(spark, folder), f"{tmp_path}/direct", f"{tmp_path}/cp1"))
    assert ids(spark.read.parquet(f"{tmp_path}/direct")) == batch
    for _ in split_sizes(spark, [500]):     # beyond the first split only landing gives the readers' ids
        done(ingest.land_logs(spark, folder, f"{tmp_path}/bronze", f"{tmp_path}/cp2", "syslog"))
        done(ingest.land_logs(spark, folder, f"{tmp_path}/bronze", f"{tmp_path}/cp2", "syslog"))
        assert ids(spark.read.parquet(f"{tmp_path}/bronze")) == batch
        for k in range(2):
            done(ingest.append_to(ingest.syslog_stream(spark, folder), f"{tmp_path}/s{k}", f"{tmp_path}/cps{k}"))
        assert ids(spark.read.parquet(f"{tmp_path}/s0")) == ids(spark.read.parquet(f"{tmp_path}/s1"))


def test_one_log_has_one_id_in_a_cascade(spark, tmp_path):
    """b is an effect of a and the root of c."""
    rows = [("08:00:00", "a", "Interface TenGigE0/2/1 went down"), ("08:01:00", "b", "BGP neighbor 192.0.2.9 is unreachable"),
            ("08:02:00", "c", "OSPF adjacency lost"), ("08:03:00", "d", "BGP neighbor 192.0.2.1 is unreachable")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(json.dumps(
        {"timestamp": f"2025-09-01T{t}Z", "source": s, "description": d}) for t, s, d in rows))
    rules_ = [("INTERFACE", "BGP", "h", 0.5), ("BGP", "OSPF", "h", 0.5), ("BGP", "BGP", "h", 0.5)]
    stream = windows.classified_stream(ingest.json_log_stream(spark, str(tmp_path / "in")))
    done(ingest.append_to(windows.cascade_stream(stream, cascade_rules=rules_), f"{tmp_path}/edges", f"{tmp_path}/cp"))
    edges = spark.read.parquet(f"{tmp_path}/edges").collect()
    logs = {r.source: r.log_id for r in readers.read_logs(spark, str(tmp_path / "in"), "jsonl").collect()}
    assert edges and all(e.root_event_id == logs[e.root_source] and e.effect_event_id == logs[e.effect_source] for e in edges)
    assert {e.effect_source for e in edges} & {e.root_source for e in edges}


def test_array_items(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"description": "same"}] * 5 + [{"description": "other"}]))
    logs = readers.read_logs(spark, str(path))
    assert len(set(ids(logs))) == 6 and ids(logs.repartition(3)) == ids(logs)


def test_rows_of_a_frame(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("string").alias("description"), F.create_map(
        F.lit("cpu"), (F.col("id") % 2).cast("double")).alias("metrics")).repartition(4)
    logs = readers.with_defaults(df, F.lit("2025-01-01").cast("timestamp"))
    got = {(r.log_id, r.description, tuple(r.metrics.items())) for r in logs.collect()}
    assert len({g[0] for g in got}) == 300
    shuffled = places.with_row_places(df.sortWithinPartitions(F.rand(5)))       # the same rows in another order
    assert {(r["_at"], r.description) for r in shuffled.collect()} == {(r["_at"], r.description) for r in places.with_row_places(df).collect()}
    with pytest.raises(ValueError):
        places.with_row_places(spark.readStream.format("rate").load())


def test_small_splits_are_bounded_in_number(spark, monkeypatch):
    from netsilt.plans import registry
    from tests.conftest import SF

    monkeypatch.setattr(registry, "SMALL_SPLIT", 100)
    monkeypatch.setattr(registry, "SMALL_SPLITS", 8)
    splits, read = [], registry.readers.read_logs
    monkeypatch.setattr(registry.readers, "read_logs", lambda s, path, fmt: splits.append(s.read.text(path).rdd.getNumPartitions()) or read(s, path, fmt))
    found = registry.QUERIES["lasting_ids"](spark, SF).collect()
    assert len(found) == 4 and all(r["logs"] == r["ids"] == r["same"] > 0 for r in found)
    assert len(splits) == 3 and splits[0] < 8 <= splits[1] <= 20
