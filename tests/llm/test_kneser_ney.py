"""The model against a dictionary-based one, and the defined results of edge cases."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from netsilt.llm import kneser_ney as K

TEXTS = ["a b a b c a b", "The cat sat on the mat", "the cat ate the rat", "a b c d e f g a b c", "", None,
         "on the mat the cat sat", "rat rat rat", "x y z a b", "the end of the cat"] * 2 + ["unseen words here", "the the the"]


def tokens(text, order):
    return ["<s>"] * (order - 1) + (text or "").lower().split() + ["</s>"]


def brute(train, order):
    """log10 probability of a text by interpolated modified Kneser-Ney."""
    counts = {order: Counter()}
    words = Counter()
    for t in train:
        seq = tokens(t, order)
        for i in range(order - 1, len(seq)):
            counts[order][tuple(seq[i - order + 1: i + 1])] += 1
            words[seq[i]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, ctx = {}, {}
    for k in counts:
        disc[k] = K.discounts([sum(c == n for c in counts[k].values()) for n in (1, 2, 3, 4)])
        ctx[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in counts[k].items():
            ctx[k][g[:-1]][0] += c
            ctx[k][g[:-1]][min(c, 3)] += 1

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(words) + 1)
        total = ctx[k].get(gram[:-1])
        if not total:
            return p(gram[1:])
        c = counts[k].get(gram, 0)
        back = sum(disc[k][i] * total[i] for i in (1, 2, 3)) / total[0]
        return max(c - disc[k][min(c, 3)], 0) / total[0] + back * p(gram[1:])

    def score(t):
        seq = tokens(t, order)
        return sum(math.log10(p(tuple(seq[i - order + 1: i + 1]))) for i in range(order - 1, len(seq)))

    def base(t):
        n = sum(words.values())
        return sum(math.log10((words[w] + 0.1) / (n + 0.1 * (len(words) + 1))) for w in tokens(t, 1))
    return score, base, p, words


@pytest.mark.parametrize("order", [2, 3])
def test_against_brute_force(spark, order):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, score string")
    held = F.col("doc_id") >= 18
    got = {r.doc_id: r for r in K.language_model_scores(docs, ~held, order).collect()}
    score, base, p, words = brute(TEXTS[:18], order)
    for i, t in enumerate(TEXTS):
        assert got[i].n_tokens == len(tokens(t, 1))
        assert got[i].n_known == sum(w in words for w in tokens(t, 1))
        assert got[i].train_tokens == sum(words.values())
        assert math.isclose(got[i].base_score, base(t), rel_tol=1e-9)
        assert math.isclose(got[i].score, score(t), rel_tol=1e-9), (i, t)
    # probabilities of all words and one unknown add up to one
    for context in (("<s>",) * (order - 1), ("the",) * (order - 1), ("a", "b")[-(order - 1):]):
        assert math.isclose(sum(p((*context, w)) for w in [*words, "never seen"]), 1, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = K.language_model_scores(docs, F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.score) for r in got) == [(1, 0, 0.0), (3, 0, 0.0)]
    assert K.language_model_scores(docs.limit(0), F.lit(True)).collect() == []


def test_unmounted_folder_is_refused():
    assert K.local_path("file:///a/b") == "/a/b" and K.local_path("/a") == "/a"
    with pytest.raises(ValueError):
        K.local_path("hdfs://name/a")
