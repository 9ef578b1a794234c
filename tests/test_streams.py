"""Streams over several micro-batches against the batch answers."""

import glob
import random
from datetime import datetime, timedelta

import pytest
from netsilt.operators import anomaly, cascade, classify, maintenance
from netsilt.schema import RAW_LOG
from netsilt.streaming import carried, ingest, windows
from pyspark.sql import functions as F
from tests.test_ordered import skewed

COMPARED = ["log_id", "source", "current_count", "burst_ratio", "is_burst"]


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    """Three files in time order, rows within a file in no order."""
    folder = tmp_path_factory.mktemp("landing")
    rows = sorted(skewed(300, 9), key=lambda r: (r[1], r[0]))
    # no time stamp is in two files: the second and third begin a microsecond later
    rows = [(*r[:1], r[1] + timedelta(microseconds=i // 100), *r[2:]) for i, r in enumerate(rows)]
    for i in range(3):
        part = rows[i * 100:(i + 1) * 100]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, RAW_LOG).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return str(folder / "in"), spark.createDataFrame(rows, RAW_LOG).persist()


def stream(spark, folder):
    return spark.readStream.schema(RAW_LOG).option("maxFilesPerTrigger", 1).parquet(folder)


def done(query):
    query.awaitTermination()
    assert query.exception() is None


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_classified_stream(spark, landing, tmp_path):
    done(ingest.append_to(windows.classified_stream(stream(spark, landing[0])), f"{tmp_path}/out", f"{tmp_path}/cp"))
    cols = ["log_id", "category", "threat_type", "recommended_action"]
    assert rows(spark.read.parquet(f"{tmp_path}/out"), *cols) == rows(classify.classify(landing[1]), *cols)


def test_dispatch_restarts_without_doubles(spark, landing, tmp_path):
    seen = []
    for _ in range(2):
        done(ingest.dispatch(stream(spark, landing[0]), f"{tmp_path}/bronze",
                             [lambda df, n: seen.append(df.count())], f"{tmp_path}/cp"))
    assert sum(seen) == 300 and len(seen) == 3
    assert spark.read.parquet(f"{tmp_path}/bronze").count() == 300


def test_failing_handler_fails_the_stream(spark, landing, tmp_path):
    def broken(df, n):
        raise RuntimeError("subscriber down")

    query = ingest.dispatch(stream(spark, landing[0]), f"{tmp_path}/bronze", [broken], f"{tmp_path}/cp")
    with pytest.raises(Exception, match="subscriber down"):
        query.awaitTermination()
    done(ingest.dispatch(stream(spark, landing[0]), f"{tmp_path}/bronze", [], f"{tmp_path}/cp"))
    assert spark.read.parquet(f"{tmp_path}/bronze").count() == 300


def test_bursts_over_batches(spark, landing, tmp_path):
    window = timedelta(minutes=30)
    # no row is late here: files come in time order and no delay is long enough to matter
    done(carried.burst_stream(stream(spark, landing[0]), str(tmp_path), window, delay=timedelta(days=2)))
    got = spark.read.parquet(f"{tmp_path}/scores")
    assert rows(got, *COMPARED) == rows(anomaly.burst_ratio(landing[1], "source", window), *COMPARED)


def test_baselines_over_batches(spark, landing, tmp_path):
    done(carried.baseline_stream(stream(spark, landing[0]), str(tmp_path), 15, delay=timedelta(0)))
    cols = ["log_id", "metric", "samples", F.round("z_score", 9)]
    want = anomaly.rolling_zscore(landing[1], 15)
    got = spark.read.parquet(f"{tmp_path}/scores")
    assert rows(got, *cols) == rows(want, *cols)


def test_device_health_over_batches(spark, landing, tmp_path):
    now = F.lit("2025-02-01").cast("timestamp")
    done(carried.device_health_stream(stream(spark, landing[0]), str(tmp_path), now, 0.0, 20, delay=timedelta(days=2)))
    latest = windows.latest_updates(spark.read.parquet(f"{tmp_path}/scores"), ["device"])
    want = maintenance.maintenance_alerts(maintenance.device_features(landing[1], 20), now, 0.0)
    cols = ["device", "failure_probability", "predicted_failure_type"]
    assert rows(latest, *cols) == rows(want, *cols)


def test_cascade_stream(spark, landing, tmp_path):
    edges = windows.cascade_stream(windows.classified_stream(stream(spark, landing[0])), delay=timedelta(days=2))
    done(ingest.append_to(edges, f"{tmp_path}/edges", f"{tmp_path}/cp"))
    cols = ["correlation_id", "root_event_id", "effect_event_id"]
    want = cascade.cascade_edges(classify.classify(landing[1]))
    assert rows(spark.read.parquet(f"{tmp_path}/edges"), *cols) == rows(want, *cols)


def test_cascade_runs_over_batches(spark, landing, tmp_path):
    """Parts that overlap in time: the edges are those of the batch, and what is written grows with the logs."""
    logs = classify.classify(landing[1])
    for k in (1, 0, 2):
        landing[1].filter(F.pmod(F.hash("log_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rule_set = [(a, b, "", 0.5) for a in ("BGP", "SECURITY", "HARDWARE") for b in ("BGP", "SECURITY", "INTERFACE")]
    window = timedelta(days=3)
    for _ in range(2):
        done(carried.cascade_run_stream(windows.classified_stream(stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", window,
                                        rule_set, delay=timedelta(days=60)))
    found = spark.read.parquet(f"{tmp_path}/out/scores")
    cols = ["correlation_id", "root_event_id", "root_source", "effect_event_id", "effect_source"]
    got, want = rows(cascade.stored_edges(found, rule_set), *cols), rows(cascade.cascade_edges(logs, window, rule_set), *cols)
    assert got == want and len(got) > found.count()
    # an effect once in the batch that has it or carries it, a root at most once per rule, batch and effect order
    assert found.count() <= 3 * 300 + 2 * 3 * 3 * 300


def late_files(spark, folder):
    base = datetime(2025, 1, 1, 12)
    schema = RAW_LOG
    make = lambda i, at: (f"L{i}", at, "d", "", "api", "", "", "INFO", "x", "y", {"cpu_usage": 1.0}, [], at)
    first = [make(1, base), make(2, base + timedelta(minutes=10))]
    second = [make(3, base + timedelta(minutes=11)), make(4, base - timedelta(hours=5))]
    third = [make(5, base + timedelta(minutes=12)), make(6, base - timedelta(hours=4))]
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_not_scored_but_land(spark, tmp_path):
    folder = str(tmp_path / "in")
    late_files(spark, folder)
    source = lambda: spark.readStream.schema(RAW_LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    done(carried.burst_stream(source(), f"{tmp_path}/b", timedelta(minutes=30), delay=timedelta(hours=1)))
    scored = rows(spark.read.parquet(f"{tmp_path}/b/scores"), "log_id")
    assert scored == [("L1",), ("L2",), ("L3",), ("L5",)]
    done(ingest.dispatch(source(), f"{tmp_path}/bronze", [], f"{tmp_path}/cp"))
    assert spark.read.parquet(f"{tmp_path}/bronze").count() == 6
    rates = windows.window_rates(source(), ["source"], timedelta(hours=1), delay=timedelta(hours=1))
    done(ingest.start_available(rates, lambda df, n: ingest.write_batch(df, f"{tmp_path}/r", n), f"{tmp_path}/cp2", "update"))
    latest = windows.latest_updates(spark.read.parquet(f"{tmp_path}/r"), ["window_start", "source"])
    # the engine drops late rows by the watermark of the batch before: the row of
    # the second file still counts, the one of the third does not
    assert rows(latest, F.hour("window_start"), "count") == [(7, 1), (12, 4)]


def test_text_streams(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "j").mkdir()
    (tmp_path / "s" / "a.log").write_text("<34>x %BGP-3-A: y\n\n")
    (tmp_path / "j" / "a.jsonl").write_text('{"log_id": "L1", "severity": "error"}\n')
    for name, source in (("s", ingest.syslog_stream), ("j", ingest.json_log_stream)):
        done(ingest.append_to(source(spark, str(tmp_path / name)), f"{tmp_path}/{name}o", f"{tmp_path}/{name}c"))
    assert spark.read.parquet(f"{tmp_path}/so").first()["component"] == "BGP"
    assert spark.read.parquet(f"{tmp_path}/jo").first()["severity"] == "ERROR"


def test_table_stream_of_a_file_and_of_a_folder(spark, landing, tmp_path):
    whole = landing[1].coalesce(1)
    whole.write.parquet(f"{tmp_path}/one")
    file = next((tmp_path / "one").glob("*.parquet"))
    for k, path in enumerate((str(file), landing[0])):
        done(ingest.append_to(ingest.table_stream(spark, path, RAW_LOG), f"{tmp_path}/o{k}", f"{tmp_path}/c{k}"))
        assert spark.read.parquet(f"{tmp_path}/o{k}").count() == 300


def test_late_logs_land_apart_and_correct_rates(spark, landing, tmp_path):
    """The three files with the second one last: what it has at or before the latest time less the delay is late."""
    names = sorted(glob.glob(f"{landing[0]}/*.parquet"), key=lambda f: spark.read.parquet(f).agg(F.max("timestamp")).first()[0])
    order = [spark.read.parquet(names[k]) for k in (0, 2, 1)]
    for part in order:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    delay = timedelta(minutes=30)
    for _ in range(2):
        done(ingest.land_on_time(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", delay))
    latest = landing[1].agg(F.max("timestamp")).first()[0]
    want = order[2].filter(F.col("timestamp") <= F.lit(latest - delay))
    late = spark.read.parquet(f"{tmp_path}/out/late").drop("batch")
    on_time = spark.read.parquet(f"{tmp_path}/out/on_time").drop("batch")
    assert rows(late, "log_id") == rows(want, "log_id") and late.count() + on_time.count() == 300 and late.count() > 50
    hour, keys = timedelta(hours=1), ["source"]
    count = lambda df: df.groupBy(F.window("timestamp", "1 hour").alias("w"), "source").agg(F.count("*").alias("count")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source", "count")
    fixed = windows.rate_corrections(count(on_time), late, keys, hour)
    assert fixed.filter("count_before = 0").count() + fixed.filter("count_before > 0").count() == fixed.count()
    touched = count(landing[1]).join(fixed.select("window_start", "source"), ["window_start", "source"])
    assert rows(fixed, "window_start", "source", "count") == rows(touched, "window_start", "source", "count")


def test_a_part_lands_as_files_of_bounded_size(spark, monkeypatch):
    """A micro-batch is as many tasks as it has files, and the results are those of single files."""
    from netsilt.plans import registry
    from tests.conftest import SF

    folders = []
    run_folder = ingest.run_folder
    monkeypatch.setattr(ingest, "run_folder", lambda s: folders.append(run_folder(s)) or folders[-1])
    monkeypatch.setattr(registry, "FILE_ROWS", 10_000)
    whole = rows(registry.QUERIES["stream_late"](spark, SF), "window_start", "category", "count_before", "count")
    monkeypatch.setattr(registry, "FILE_ROWS", 100)
    assert rows(registry.QUERIES["stream_late"](spark, SF), "window_start", "category", "count_before", "count") == whole and whole
    landed = [len(glob.glob(f"{f}/landed/*.parquet".replace("file:", ""))) for f in folders]
    assert sorted(n for n in landed if n) == [3, 12]


def test_chains_have_the_batch_ids_in_files_of_many_splits(spark):
    from netsilt.plans import registry
    from tests.conftest import SF

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        found = registry.QUERIES["stream_chains"](spark, SF).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found["edges"] == found["known"] > 0
