"""Held-out accuracy, defined results, and filtering."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from netsilt.llm import toxicity as T
from tests.llm.conftest import words

BAD = ["vileword", "nastyterm", "rudething"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for d in range(600):
        text, toxic = words(rng, rng.randrange(20, 300)), d % 5 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD).upper() + rng.choice(["s", "", "ish"]))
        docs.append((d, " ".join(text)))
        labels.append((d, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    got = T.toxicity(docs, labels, learn_from=F.col("doc_id") % 3 != 1).collect()
    held = [r for r in got if r.doc_id % 3 == 1]
    assert len(got) == 600 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_filter_keeps_clean_documents(labelled):
    docs, labels, truth = labelled
    kept = {r.doc_id for r in T.without_toxic(docs, labels).collect()}
    assert len(kept & {d for d, t in truth.items() if t}) <= 6 and {d for d, t in truth.items() if not t} - kept == set()


def test_score_is_of_the_whole_text_and_the_same_in_any_batch(labelled, monkeypatch):
    docs, labels, _ = labelled
    model = T.train(T.labelled_sample(docs, labels))
    rng = random.Random(2)
    texts = [" ".join(words(rng, n)).encode() for n in (0, 1, 5, 400, 3000)]
    texts += [texts[-1] + b" vileword nastyterm rudething rudethings", "é ü 한".encode(), b"\xff\xfe broken"]
    alone = [float(model.scores([t])[0]) for t in texts]
    assert np.allclose(alone, model.scores(texts))
    assert alone[5] > alone[4] + 0.3
    monkeypatch.setattr(T, "CHARS", 500)    # long texts are hashed in overlapping stretches
    assert np.allclose(alone, model.scores(texts))


def test_messy_rows_and_little_to_learn(spark, messy):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.toxicity(messy, none).select(F.round("score", 6).alias("score")).collect()} == {0.0}
    one = spark.createDataFrame([(3, 1), (None, 1), (5, None), (5, 7)], "doc_id long, toxic int")
    assert {r.predicted for r in T.toxicity(messy, one).collect()} == {1}
    both = spark.createDataFrame([(3, 1), (5, 0), (6, 0), (3, 0)], "doc_id long, toxic int")
    out = T.toxicity(messy, both)
    assert out.count() == messy.count() and out.filter("score is null").count() == 0
    assert T.without_toxic(messy, none).columns == messy.columns and T.without_toxic(messy, none).count() == messy.count()
    assert T.toxicity(messy.limit(0), both).collect() == []


def test_learning_takes_little_memory_and_sums_in_row_order(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 2048, rng.integers(0, 900))).astype(np.int16) for _ in range(6000)]
    y, scale = (rng.random(6000) < 0.2).astype(float), rng.normal(size=2048)
    tracemalloc.start()
    w, bias = T.logistic(rows, y, scale, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(map(len, rows)) + (16 << 20)      # it took 24 bytes for each feature of a row
    monkeypatch.setattr(T, "BLOCK_FEATURES", 1 << 40)
    whole = T.logistic(rows, y, scale, steps=3)
    assert (w == whole[0]).all() and bias == whole[1]


def test_best_buckets_by_parts(monkeypatch):
    monkeypatch.setattr(T, "BITS", 12)
    monkeypatch.setattr(T, "FEATURES", 300)
    counts, n = np.random.default_rng(4).integers(0, 6, (2, 1 << 12)), np.array([20, 9])
    parts = [Row(part=k, counts=p.tobytes()) for k, p in enumerate(np.split(counts, 64, axis=1))]
    best, ratio = T._best(parts[::-1], n)
    all_ratios, gain = T._ratio(counts, n)
    order = np.lexsort((np.arange(1 << 12), -gain))[:300]
    assert (best == order).all() and (gain[best] > 0).all() and (ratio == all_ratios[best]).all()
