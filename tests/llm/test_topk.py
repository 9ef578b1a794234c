"""The best rows against all inner products."""

import math
import random

from pyspark.sql import functions as F

from netsilt.llm import topk as K


def slow(rows, k=10):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(1024 * float(c)) for c in v]
            best[i] = max(best.get(i, x), x) if len(best.get(i, x)) == len(x) else x
    out = []
    for q in best:
        if q % 100 == 0:
            scores = sorted((-sum(map(int.__mul__, best[q], c)), i) for i, c in best.items() if i != q and len(c) == len(best[q]))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def fast(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    return sorted(tuple(r) for r in K.nearest(df, F.col("vec_id") % 100 == 0, **options).collect())


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(20)]) for i in range(-200, 700)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]                      # many equal vectors
    rows += [(5000, [1.0] * 20), (5000, [1.0] * 19 + [2.0]), (5000, [1.0] * 20)]   # one id, several vectors
    monkeypatch.setattr(K, "LEAST_CHUNKS", 3)
    monkeypatch.setattr(K, "BLOCK_ROWS", 4)
    monkeypatch.setattr(K, "TILE", 64)
    assert fast(spark, rows) == slow(rows)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAST_CHUNKS", 2)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, -0.0004]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
            (None, [1.0, 1.0]), (100, []), (200, []), (300, [1.0, 2.0, 3.0]), (400, [1e12, 1e12]), (6, [1e12, -3.0])]
    got = fast(spark, rows)
    want = [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in slow(rows)]
    assert got == want
    assert fast(spark, []) == []


def test_bounds_hold():
    import numpy as np
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 24)), rng.normal(size=(60, 24))
    exact = a @ b.T
    coarse, fine = (K.statistics(a, s) @ K.statistics(b, s).T for s in (3, 12))
    assert (coarse >= exact - 1e-9).all() and (fine >= exact - 1e-9).all() and (fine <= coarse + 1e-9).all()
