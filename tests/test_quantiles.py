"""Exact order statistics, seeded baselines and the ledger of subscribers."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from netsilt.functions import quantiles
from netsilt.operators import anomaly
from netsilt.schema import RAW_LOG
from netsilt.streaming import ingest
from tests.conftest import raw_row


@pytest.mark.parametrize("bins", [3, 4096])
def test_quantiles_are_numpys(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(1)
    for values in ([5.0], [1.0, 1.0], [rng.random() for _ in range(301)], [float(rng.randrange(4)) for _ in range(200)],
                   [1e-300, 1.0, 1e300, -1e300]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        for share in (0.0, 0.05, 0.5, 0.77, 1.0):
            assert quantiles.exact_quantile(df, "v", share) == pytest.approx(np.quantile(values, share), rel=1e-12)
    assert quantiles.exact_quantile(df.filter("v is null"), "v", 0.5) is None


def test_training_seeds_the_baselines(spark):
    """Samples of a training run come first, whatever their time, and only the last of them count."""
    rng = random.Random(2)
    start = datetime(2025, 1, 1)

    def logs(prefix, n, shift):
        return [raw_row(f"{prefix}{i:03d}", f"d{i % 2}", "api", "INFO", "x", "x", rng.randrange(100), 5, 0, start + timedelta(minutes=i + shift))
                for i in range(n)]
    seen, new = logs("H", 60, 10_000), logs("N", 40, 0)
    got = {(r.log_id, r.metric): (r.samples, r["mean"], r["std"]) for r in anomaly.rolling_zscore(
        spark.createDataFrame(new, RAW_LOG), 12, history=spark.createDataFrame(seen, RAW_LOG)).collect()}
    cpu = lambda row: row[10]["cpu_usage"]
    for device in ("d0", "d1"):
        line = [cpu(r) for r in seen if r[2] == device]
        for row in (r for r in new if r[2] == device):
            line.append(cpu(row))
            n, mean, std = got[(row[0], "cpu_usage")]
            assert n == 12 and mean == pytest.approx(np.mean(line[-12:])) and std == pytest.approx(np.std(line[-12:]))
    assert len(got) == 40 * 3


def test_handlers_run_once_per_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.jsonl").write_text('{"description": "a"}\n{"description": "b"}\n')
    calls, broken = [], [True]

    def first(batch, batch_id):
        calls.append(("first", batch_id, batch.count()))

    def second(batch, batch_id):
        if broken[0]:
            raise RuntimeError("subscriber down")
        calls.append(("second", batch_id, batch.count()))

    def run():
        q = ingest.dispatch(ingest.json_log_stream(spark, str(tmp_path / "in")), str(tmp_path / "bronze"), [first, second], str(tmp_path / "cp"))
        q.awaitTermination()
    for _ in range(2):
        with pytest.raises(Exception):
            run()
    broken[0] = False
    run()
    run()
    assert sorted(calls) == [("first", 0, 4), ("second", 0, 4)]
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 4


def test_several_quantiles_take_the_passes_of_one(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 16)
    values = np.random.default_rng(5).gamma(0.3, 40.0, 3000).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").persist()
    shares = [0.0, 0.01, 0.05, 0.37, 0.5, 0.5, 1.0]

    def jobs(group, some):
        spark.sparkContext.setJobGroup(group, group)
        found = quantiles.exact_quantiles(df, "v", some)
        spark.sparkContext.setJobGroup("other", "other")
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    found, several = jobs("several", shares)
    assert found == pytest.approx(list(np.quantile(values, shares)), rel=1e-12)
    assert several <= 2 * max(jobs(f"one-{k}", [share])[1] for k, share in enumerate(shares))
    assert quantiles.exact_quantiles(df.filter("v is null"), "v", shares) == [None] * len(shares)
