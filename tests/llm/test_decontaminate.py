"""Overlaps with benchmark items, substitutions included."""

import random

import numpy as np

from netsilt.llm import decontaminate as D
from tests.llm.conftest import words


def test_longest_overlap():
    rng = random.Random(4)
    for _ in range(300):
        same = np.array([rng.random() < 0.75 for _ in range(rng.randrange(1, 40))])
        best = 0
        for a in range(len(same)):
            for b in range(a + 1, len(same) + 1):
                if same[a] and same[b - 1] and 5 * same[a:b].sum() >= 4 * (b - a):
                    best = max(best, b - a)
        a, b = D.longest_overlap(same, 0.8)
        assert b - a == best
        assert not best or (same[a] and same[b - 1] and 5 * same[a:b].sum() >= 4 * (b - a))


def test_planted_leaks_are_found_and_others_left_alone(spark):
    rng = random.Random(5)
    items = [(k, " ".join(words(rng, rng.randrange(13, 60), 3000))) for k in range(30)] + [(99, None), (98, "too short"), (97, "")]
    rows, leaked = [], {}
    for d in range(300):
        text = words(rng, rng.randrange(0, 200), 3000)
        if d % 3 == 0:
            k = rng.randrange(30)
            passage = items[k][1].split()
            for at in range(3, len(passage), 7):          # every seventh word is another
                passage[at] = "other"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," for w in passage]
            leaked[d] = (k, at, len(passage))
        rows.append((d, " ".join(text)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.overlaps(docs, bench).collect()}
    assert set(got) == set(leaked)
    for d, (k, at, n) in leaked.items():
        assert got[d].item_id == k and at <= got[d].start <= at + 3 and got[d].words >= n - 7
        assert got[d].same_words >= 0.8 * got[d].words
    kept = {r.doc_id for r in D.without_leaks(docs, bench).collect()}
    assert kept == set(range(300)) - set(leaked)


def test_long_items_and_repeated_ones(spark):
    rng = random.Random(6)
    item = words(rng, 1500, 5000)
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[700:1100])), (3, " ".join(item[:10]))], "doc_id long, text string")
    bench = spark.createDataFrame([(8, " ".join(item)), (4, " ".join(item).upper())], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.words) for r in D.overlaps(docs, bench).collect())
    assert got == [(1, 4, 0, 1500), (2, 4, 0, 400)]


def test_messy_rows(spark, messy):
    bench = messy.selectExpr("doc_id as item_id", "text", "key").filter("doc_id = 13 or doc_id is null or text = ''")
    found = {(r.doc_id, r.item_id) for r in D.overlaps(messy, bench).collect()}
    assert (13, 13) in found and all(i is not None or d in (None, 5, 6, 7, 12) for d, i in found)
    kept = D.without_leaks(messy, bench)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 13 not in ids and ids.count(3) == 3 and 8 in ids
    assert D.overlaps(messy, bench.limit(0)).collect() == [] and D.overlaps(messy.limit(0), bench).collect() == []
    assert D.without_leaks(messy, bench.limit(0)).count() == messy.count()
