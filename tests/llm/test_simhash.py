"""Fingerprints, ball hashing and groups against brute force."""

import random

import numpy as np
import xxhash

from netsilt.llm import simhash as S
from netsilt.llm.components import components, forest
from tests.llm.conftest import words


def slow_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i: i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """prints: [(doc, fp)] -> doc -> smallest doc reachable."""
    group = {fp: {fp} for _, fp in prints}
    fps = sorted(group)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                merged = group[a] | group[b]
                for x in merged:
                    group[x] = merged
    return {fp: min((d for d, f in prints if f in group[fp] and d is not None), default=None) for fp in fps}


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 299, 303, 900):
        text = " ".join(words(rng, n)).upper()
        assert S.fingerprint(text.encode()) == slow_fingerprint(text)


def test_links_find_every_distance_up_to_three(spark):
    rng = random.Random(2)
    fps = []
    for _ in range(60):
        a = rng.getrandbits(64)
        fps.append(a)
        for bits in (1, 2, 3, 3, 4, 5):
            b = a
            for k in rng.sample(range(64), bits):
                b ^= 1 << k
            fps.append(b)
    prints = [(i, fp) for i, fp in enumerate(fps)]
    df = spark.createDataFrame([(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in prints], "doc_id long, fp long")
    linked = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in S.links(df, S._least_hub).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in map(tuple, linked))
    roots = {r.node % (1 << 64): r.root for r in components(S.links(df)).collect()}
    least = slow_components(prints)
    for _, a in prints:
        for _, b in prints:
            assert (least[a] == least[b]) == (a == b or (a in roots and b in roots and roots[a] == roots[b]))


def test_whole_query_with_messy_rows(spark, messy):
    got = S.near_duplicates(messy).collect()
    rows = messy.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    prints = [(r.doc_id, slow_fingerprint(r.text)) for r in rows]
    least = slow_components(prints)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(
        ((d, f"{fp:016x}", least[fp]) for d, fp in prints), key=key)
    assert S.near_duplicates(messy.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, k) for k in range(1001, 1200)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{k: 1000 for k in range(1000, 1200)}, 500: 500, 501: 500}
    node, root = forest(np.array([3, 5, 9, 4]), np.array([2, 3, 8, 5]))
    assert dict(zip(node.tolist(), root.tolist())) == {3: 2, 4: 2, 5: 2, 9: 8}


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))}
    one, two = grams(a), grams(b)
    return len(one & two) / len(one | two)


def test_one_document_of_each_group(spark):
    rng = random.Random(3)
    rows, copies = [], set()
    for k in range(40):
        text = words(rng, 400, 5000)
        rows.append((10 * k, " ".join(text)))
        rows.append((10 * k + 1, " ".join(text)))
        copies.add(10 * k + 1)
        near = list(text)
        near[rng.randrange(400)] = "changed"
        rows.append((10 * k + 2, " ".join(near)))
        copies.add(10 * k + 2)
        rows.append((10 * k + 3, " ".join(words(rng, 400, 5000))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in S.distinct_documents(docs).collect()}
    assert {d for d, _ in rows} - copies <= kept          # nothing else is dropped
    assert len(kept & copies) <= 4                         # nearly all near copies are found
    assert all(d % 10 == 2 for d in kept & copies)         # exact copies are all found
    texts = dict(rows)
    groups = S.similar_documents(docs).filter("digest != keeps_digest").collect()
    assert groups and all(jaccard(texts[r.doc_id], texts[r.keeps_doc_id]) >= 0.8 for r in groups)


def test_distinct_documents_of_messy_rows(messy):
    messy = messy.selectExpr("*", "'c' as `a.b`")
    kept = S.distinct_documents(messy)
    assert kept.columns == messy.columns
    texts = [r.text for r in kept.collect()]
    assert len({t or "" for t in texts}) == len(texts)
    assert S.distinct_documents(messy.limit(0)).collect() == []


def slow_groups(texts, similarity=0.8):
    """{doc: text} -> doc -> smallest doc over similar pairs within 3 bits, from all pairs."""
    low = {d: t.lower().encode().split() for d, t in texts.items()}
    fps = {d: slow_fingerprint(" ".join(sorted({w.decode() for w in ws})), 1) for d, ws in low.items()}
    grams = {d: {hash(tuple(ws[i: i + 5])) for i in range(max(1, len(ws) - 4))} for d, ws in low.items()}
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d
    docs = sorted(texts)
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 3 and top(a) != top(b):
                both = len(grams[a] & grams[b])
                if both >= similarity * (len(grams[a]) + len(grams[b]) - both):
                    root[max(top(a), top(b))] = min(top(a), top(b))
    return {d: top(d) for d in texts}


def test_groups_of_many_near_copies_are_whole(spark, monkeypatch):
    rng = random.Random(5)
    texts = {}

    def copies(at, text, n, changed, word):
        for k in range(n):
            near = list(text)
            for i in rng.sample(range(len(text)), changed):
                near[i] = word(k, i)
            texts[at + k] = " ".join(near)
    one, two = words(rng, 400, 5000), words(rng, 400, 300)
    copies(0, one, 400, 6, lambda k, i: f"n{k}x{i}")
    texts[5000] = " ".join(one)                                 # the original has the largest doc_id
    copies(1000, two, 150, 6, lambda k, i: rng.choice(two))     # many of one fingerprint
    texts[6000] = " ".join(two)
    for k in range(40):                                         # one set of words, many texts
        texts[2000 + k] = " ".join(rng.sample(two, len(two)))
    chain = words(rng, 200, 5000)                               # each similar to the last only
    for k in range(30):
        chain[5 * k] = chain[(5 * k + 7) % 200]
        texts[3000 + k] = " ".join(chain)
    slow = slow_groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    for least in (S.LEAST_BUCKETS, 3):
        monkeypatch.setattr(S, "LEAST_BUCKETS", least)
        assert {r.doc_id: r.keeps_doc_id for r in S.similar_documents(docs).collect()} == slow


def test_sketches_never_differ_in_more_bits_than_sets_do():
    rng = np.random.default_rng(6)
    bits = lambda a, b: sum(int(x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) % (1 << 64)).bit_count()
                            for x, y in zip(S._parities(a), S._parities(b), strict=True))
    for changed in (0, 1, 5, 40, 300):
        one = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64) << np.uint64(1))
        two = np.unique(np.concatenate([one[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64) << np.uint64(1)]))
        apart = len(np.setxor1d(one, two))
        assert bits(one, two) <= apart and (bits(one, two) > 0) == (apart > 0)


def test_texts_at_the_edge_of_a_large_group_form_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    text, texts = words(rng, 150, 5000), {}
    for k in range(500):                         # from near the original to too far from any other copy
        near = list(text)
        for i in rng.sample(range(150), 1 + k % 8):
            near[i] = f"n{k}x{i}"
        texts[k] = " ".join(near)
    made = {}
    monkeypatch.setattr(S, "stored", lambda df, name, *by, real=S.stored: made.setdefault(name, []).append(real(df, name, *by)) or made[name][-1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    groups = {r.doc_id: r.keeps_doc_id for r in S.similar_documents(docs).collect()}
    assert groups == slow_groups(texts) and 50 < len(set(groups.values())) < 450
    assert sum(df.count() for name in made if name.startswith("text-pairs-") for df in made[name]) < 4 * len(texts)
