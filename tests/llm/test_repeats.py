"""Removed words against a brute-force version."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from netsilt.llm import repeats as R
from tests.llm.conftest import words


def slow(rows, window):
    """[(doc_id, text)] -> sorted [(doc_id, n_words, kept words)]"""
    last = 1 << 63
    first = defaultdict(lambda: last + 1)
    for d, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            g = tuple(w[k: k + window])
            first[g] = min(first[g], last if d is None else d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k: k + window])] < (last if d is None else d):
                gone[k: k + window] = [True] * window
        out.append((str(d), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def fast(docs, window):
    got = R.without_repeats(docs, window).select("row.doc_id", "text", "n_words", "n_removed").collect()
    return sorted((str(r.doc_id), r.n_words, r.n_removed, b" ".join(bytes(r.text or b"").split())) for r in got)


def corpus(seed, vocabulary):
    rng = random.Random(seed)
    shared = [words(rng, rng.randrange(8, 90), vocabulary) for _ in range(12)]
    rows = []
    for d in rng.sample(range(1000), 60):
        text = []
        for _ in range(rng.randrange(5)):
            text += words(rng, rng.randrange(30), vocabulary)
            passage = rng.choice(shared)
            a = rng.randrange(len(passage))
            text += passage[a: a + rng.randrange(1, 90)] if rng.random() < 0.5 else passage
        rows.append((d, " ".join(text)))
    return rows


def test_against_brute_force(spark):
    for seed, vocabulary, window in ((1, 500, 10), (2, 3, 10), (3, 2, 4), (4, 50, 50)):
        rows = corpus(seed, vocabulary)
        assert fast(spark.createDataFrame(rows, "doc_id long, text string"), window) == slow(rows, window), seed


def test_small_groups_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(R, "GROUP_WINDOWS", 40)
    rows = corpus(5, 30)
    assert fast(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 12) == slow(rows, 12)


def test_messy_rows(messy):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    assert fast(messy, 50) == slow(rows, 50)
    out = R.documents_without_repeats(messy)
    assert out.columns == messy.columns and out.count() == messy.count()
    # untouched texts are as they were, null stays null
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, None) in kept and (2, "  \n\t ") in kept
    assert R.documents_without_repeats(messy.limit(0)).collect() == []


def test_one_hot_passage(spark):
    passage = " ".join(f"p{k}" for k in range(120))
    rows = [(d, f"a{d} b{d} {passage} c{d}") for d in range(300)]
    got = R.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got.agg(F.sum("n_removed"), F.min("n_removed")).first()[:] == (299 * 120, 0)


def test_rows_of_one_doc_id_in_one_partition(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "pq")
    later = [(None, f"a {one}"), (None, f"b {one} c"), (None, f"{two} {one}"), (9, f"d {two}"), (9, f"{two} e {one}"), (9, two)]
    earlier = [(7, f"f {one} g"), (8, f"h {two}"), (7, f"{one} {one}")]
    rows = spark.sparkContext.parallelize(later + earlier, 3)   # three rows each
    assert fast(spark.createDataFrame(rows, "doc_id long, text string"), 50) == slow(later + earlier, 50)
