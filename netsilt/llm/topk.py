"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments; of each it keeps the mean and the deviation. For two
vectors, the sum over segments of (segment length) * ((difference of means)^2 +
(difference of deviations)^2) is a lower bound of their squared distance, and finer
segments bound it better. A query first meets every candidate at the coarsest
resolution; those that may still be among its best are bounded again at the next one,
and for the survivors the distance is computed exactly. With the vectors' own norms
a distance gives the inner product, by which results are ranked:

    q . c = (|q|^2 + |c|^2 - distance^2) / 2

Queries and candidates meet in blocks: candidates are dealt into chunks by a hash
of their id, queries into blocks, and each pair of chunk and block is one task's work of
bounded size. It returns ten rows a query; the best of those are the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsilt.llm.common import share

K = 10
SCALE = 1024
SEGMENTS = (4, 16)          # per vector, coarse to fine
CHUNK_ROWS = 32_768         # candidates of one task
BLOCK_ROWS = 16_384         # queries of one task
LEAST_CHUNKS = 64
TILE, BATCH = 4096, 256     # candidates and queries bounded at once
_EXACT = 2.0 ** 53          # integers up to here are exact in doubles


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per vector and segment sqrt(length) * mean and sqrt(length) * deviation, side by side:
    the inner product of two such rows is at least that of the vectors."""
    d = x.shape[1]
    cuts = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
    length = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    squares = np.add.reduceat(x * x, cuts[:-1], axis=1)
    return np.concatenate([total / np.sqrt(length), np.sqrt(np.maximum(squares - total * total / length, 0))], axis=1)


def _merge(best, q, score, ids, k):
    """The k best (score down, id up) of each query from what it had and new pairs."""
    q, score, ids = (np.concatenate([a, b]) for a, b in zip(best, (q, score, ids), strict=True))
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], score[keep], ids[keep]


def search(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int = K
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, score, candidate id) of each query's k best candidates but itself."""
    # long rows first: they set high thresholds early
    order = np.lexsort((ids, -(candidates * candidates).sum(axis=1)))
    candidates, ids = candidates[order], ids[order]
    # of equal vectors the k + 1 smallest ids suffice
    _, same = np.unique(candidates, axis=0, return_inverse=True)
    by = np.lexsort((ids, same.ravel()))
    place = np.arange(len(by)) - np.searchsorted(same.ravel()[by], same.ravel()[by])
    keep = np.sort(by[place <= k])
    candidates, ids = candidates[keep], ids[keep]
    levels = [(statistics(queries, s), statistics(candidates, s)) for s in SEGMENTS if s < queries.shape[1]]
    norms = [(x * x).sum(axis=1) for x in (queries, candidates)]
    found = []
    for a in range(0, len(queries), BATCH):
        rows = np.arange(a, min(a + BATCH, len(queries)))
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        threshold = np.full(len(rows), -np.inf)
        for b in range(0, len(candidates), TILE):
            tile = slice(b, b + TILE)
            q, c = np.nonzero(query_ids[rows][:, None] != ids[tile][None, :])
            if levels and np.isfinite(threshold).any():
                (ql, cl), finer = levels[0], levels[1:]
                squares = norms[0][rows][:, None] + norms[1][tile][None, :]
                lower = squares - 2 * (ql[rows] @ cl[tile].T)      # of the squared distance
                bound = (squares - lower) / 2
                alive = (bound + 1 + 1e-9 * np.abs(bound) >= threshold[:, None])[q, c]
                q, c = q[alive], c[alive]
                for ql, cl in finer:
                    bound = np.einsum("ij,ij->i", ql[rows[q]], cl[tile][c])
                    alive = bound + 1 + 1e-9 * np.abs(bound) >= threshold[q]
                    q, c = q[alive], c[alive]
            if len(q) * 4 > len(rows) * len(ids[tile]):
                score = (queries[rows] @ candidates[tile].T)[q, c]
            else:
                score = np.einsum("ij,ij->i", queries[rows[q]], candidates[tile][c])
            good = score >= threshold[q]
            best = _merge(best, q[good], score[good], ids[tile][c[good]], k)
            last = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1)
            threshold[best[0][last]] = best[1][last]
        found.append((best[0] + a, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _large(queries, query_ids, candidates, ids, k):
    """The same for integers too large for doubles, saturated at the ends of a long."""
    low, high = -(1 << 63), (1 << 63) - 1
    rows = []
    for i, (q, own) in enumerate(zip(queries.tolist(), query_ids.tolist(), strict=True)):
        scores = [(-min(max(sum(map(int.__mul__, q, c)), low), high), n)
                  for c, n in zip(candidates.tolist(), ids.tolist(), strict=True) if n != own]
        rows += [(i, -s, n) for s, n in sorted(scores)[:k]]
    return tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors, one per id: the greatest of those that share it."""
    ids = table.column("id").to_numpy()
    flat = table.column("vector").combine_chunks()
    flat = (flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy()
    x = flat.reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    last = np.append(ids[1:] != ids[:-1], True)
    return ids[last], x[last]


def _meet(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        ids, x = _vectors(candidates)
        query_ids, q = _vectors(queries)
        reach = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * max(1, x.shape[1])
        if reach < _EXACT and x.shape[1]:
            row, score, found = search(q.astype(float), query_ids, x.astype(float), ids, k)
        else:
            row, score, found = _large(q, query_ids, x, ids, k)
        return pa.table([query_ids[row], found, score.astype(np.int64)], schema=_FOUND)
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors(vec_id, embedding)`` where
    ``is_query`` holds its k best other rows by inner product of the components'
    floor(scale * x), ties to the smaller vec_id; all, if there are fewer.

    Null ids, null vectors and vectors with null or non-finite components take no part.
    Only vectors of equal length are compared. Rows that share a vec_id count once, with
    their greatest vector. Scores beyond a long are its nearest value.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < math.inf))
    good = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("id"), is_query.alias("asks"),
        F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("vector"), F.size(x).alias("dim"))
    rows, asking = good.agg(F.count("*"), F.count_if("asks")).first()
    chunks, blocks = share(rows, CHUNK_ROWS, LEAST_CHUNKS), share(asking, BLOCK_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    candidates = good.select("dim", part(chunks).alias("chunk"), every(blocks).alias("block"), "id", "vector")
    queries = good.filter("asks").select("dim", every(chunks).alias("chunk"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
                                         .cast("int").alias("block"), "id", "vector")
    cell = ["dim", "chunk", "block"]
    found = candidates.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(
        _meet(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
