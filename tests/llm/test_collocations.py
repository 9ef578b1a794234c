"""Phrases against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from netsilt.llm import collocations as C


def brute_force(rows, most, least, top, inside):
    grams, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, most + 1):
                grams.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    found = {g: a for g, a in grams.items() if len(g) > 2 and a >= least}
    around: dict = {}
    for (lang, *w), a in found.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                key = (lang, *w[i:i + n])
                around[key] = max(a, around.get(key, 0))
    out = []
    for lang in total:
        ranked = []
        for g, a in found.items():
            if g[0] == lang and 100 * around.get(g, 0) < inside * a:
                w = g[1:]
                cuts = [(1000000 * a * a // (grams[(lang, *w[:k])] * grams[(lang, *w[k:])]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                ranked.append((-score, -a, " ".join(w).encode(), grams[(lang, *w[:k])], grams[(lang, *w[k:])]))
        ranked.sort()
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(ranked[:top], 1)]
    return sorted(out)


def found(spark, rows, **params):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    return sorted(tuple(r) for r in C.collocations(df, **params).collect())


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(12)] + ["über", "한", "x-y", "'s", "a b"]
    ends = [" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", ";!", "  "]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [("".join(rng.choices(vocabulary, weights)[0] + rng.choice(ends) for _ in range(rng.randrange(60))),
             rng.choice(["en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("most, inside", [(2, 50), (3, 50), (3, 10), (4, 30)])
def test_against_brute_force(spark, monkeypatch, most, inside):
    monkeypatch.setattr(C, "FLUSH_TOKENS", 97)     # many flushes within texts
    rows = texts(150, most) + [(None, "en"), ("", None), (" .. ", "fr"), ("lone", "xx")]
    want = brute_force(rows, most, 3, 25, inside)
    assert found(spark, rows, max_words=most, min_count=3, top=25, inside=inside) == want and len(want) > 40


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE_BYTES", 50)
    monkeypatch.setattr(C, "FLUSH_TOKENS", 40)
    rows = [(" ".join(t for t, _ in texts(80, 9)), "en"), ("q" * 300 + " r" * 30, "en")] + texts(20, 8)
    assert found(spark, rows, min_count=2, top=500) == brute_force(rows, 3, 2, 500, 50)


def test_messy(spark, messy):
    rows = [(r.text, r.lang) for r in messy.select("text", "lang").collect()]
    df = messy.selectExpr("*", "1 as f", "2 as words", "'x' as key", "'x' as word", "0 as a")
    assert sorted(tuple(r) for r in C.collocations(df, min_count=2).collect()) == brute_force(rows, 3, 2, 2000, 50)
    assert C.collocations(messy.limit(0)).collect() == []


def test_two_words_of_one_key_are_noticed(spark, monkeypatch):
    """With the first seed every word of a language has one key; the second one tells them apart."""
    df = spark.createDataFrame([("a b a b", "en")] * 5, "text string, lang string")
    texts_ = C.fixed(df, text=C.as_bytes("text"), lang=df.lang)

    def clashing(seed, own=C._count_words):
        run = own(seed)

        def spoilt(batches):
            for batch in run(batches):
                yield batch if seed else batch.set_column(0, "key", C.pa.array([7] * batch.num_rows, C.pa.int64()))
        return spoilt
    monkeypatch.setattr(C, "_count_words", clashing)
    words, seed = C.vocabulary(texts_, 2)
    assert seed == 1 and {(r.word, r.f) for r in words.collect()} == {("a", 10), ("b", 10), ("", 20)}


def test_counts_flow_from_long_grams():
    rng = np.random.default_rng(2)
    ids, joined = rng.integers(0, 5, 400), rng.random(399) < 0.8
    for starts in (400, 390, 0):
        got = C.gram_counts(ids, joined, starts, 4)
        for n, (columns, counts) in enumerate(got, 1):
            want = Counter(tuple(ids[i:i + n].tolist()) for i in range(min(starts, 400 - n + 1))
                           if ids[i:i + n].all() and joined[i:i + n - 1].all())
            assert dict(zip(zip(*[c.tolist() for c in columns]), counts.tolist())) == want


def test_compaction(spark, monkeypatch):
    """Unary paths are joined, branches end them, a circle stays single edges, long paths are cut."""
    def edges(*walks):
        return {tuple(w[i:i + 3]): 10 + i for w in walks for i in range(len(w) - 2)}
    line, fork, circle, loop = list(range(100, 140)), [1, 2, 3, 4, 5], [7, 8, 9, 7, 8], [6, 6, 6]
    given = edges(line, fork, [1, 2, 3, 4, 50], [60, 2, 3, 4], circle, loop)
    df = spark.createDataFrame([(list(w), f) for w, f in given.items()], "words array<long>, f long")
    for limit, longest in ((1000, 38), (10, 10)):
        monkeypatch.setattr(C, "PATH_EDGES", limit)
        got = [(r.words, r.weights) for r in C.compact(df).collect()]
        assert max(len(w) for _, w in got) == longest
        assert {tuple(w[i:i + 3]): f for w, fs in got for i, f in enumerate(fs)} == given
        assert sum(len(fs) for _, fs in got) == len(given) and all(len(w) == len(fs) + 2 for w, fs in got)
    assert [7, 8, 9] in [w for w, _ in got] and [6, 6, 6] in [w for w, _ in got]
    empty = spark.createDataFrame([], "words array<long>, f long")
    assert C.compact(empty).collect() == []
