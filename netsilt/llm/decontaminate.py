"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select five words of a stretch and ignore those between, so a
substituted word at an ignored position does not matter. Every position of every
document is hashed under every mask. A bit table of fixed size drops what no
benchmark item has; what is left meets the items' hashes in a join. Around each
hit the document's words are laid against the item's along the hit's diagonal, and
the longest stretch with enough equal words is the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsilt.llm.bloom import bit_table, maybe_in
from netsilt.llm.common import mix, record, some_rows, stored, unpacked, whole_row, word_hashes

#: 1 selects a word, 0 ignores it.
MASKS = ("11111", "110111", "1101011", "11100101", "1010110011")

SIMILARITY = 0.8     # equal words per word of an overlap, at least
MIN_WORDS = 13       # of an overlap, or all words of a shorter item
REACH = 64           # words a document shows on either side of its hits
TABLE_BITS = 25
_PUNCTUATION = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))
_U = np.uint64


def normal_words(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words between white space and ASCII punctuation."""
    return word_hashes([t.translate(_PUNCTUATION) for t in texts])


def seeds(h: np.ndarray) -> Iterator[np.ndarray]:
    """Per mask the hash that starts at each word."""
    for k, mask in enumerate(MASKS):
        n = len(h) - len(mask) + 1
        if n < 1:
            yield h[:0]
            continue
        total = np.full(n, k + 1, dtype=_U)
        for at, chosen in enumerate(mask):
            if chosen == "1":
                total *= _U(0x9FB21C651E98DF25)
                total += h[at: at + n]
        yield mix(total)


def longest_overlap(same: np.ndarray, similarity: float) -> tuple[int, int]:
    """The longest stretch [a, b) that begins and ends on equal words and has a share of
    at least ``similarity`` of them; (0, 0) if there is none."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    # scaled to integers: a stretch is good if its sum is not negative
    worth = np.concatenate([[0], np.cumsum(np.where(same, round(1000 * (1 - similarity)), -round(1000 * similarity)))])
    low = np.minimum.accumulate(worth[at])          # over possible starts
    best = (0, 0)
    first = np.searchsorted(-low, -worth[at + 1], side="left")   # earliest start not above the end
    for k, end in enumerate(at + 1):
        if first[k] <= k and end - at[first[k]] > best[1] - best[0]:
            best = (int(at[first[k]]), int(end))
    return best


_ITEMS = pa.schema([("item_id", pa.int64()), ("words", pa.binary()), ("keys", pa.list_(pa.int64())), ("ats", pa.list_(pa.int32()))])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = normal_words(batch.column("text").to_pylist())
        keys = [list(seeds(h)) for h in words]
        yield record(_ITEMS, batch.column("item_id"), [h.tobytes() for h in words],
                     [np.concatenate(k).view(np.int64) for k in keys],
                     [np.concatenate([np.arange(len(x)) for x in k]).astype(np.int32) for k in keys])


_REGIONS = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("start", pa.int64()), ("words", pa.binary()),
                      ("keys", pa.list_(pa.int64())), ("ats", pa.list_(pa.int32()))])
REGIONS = "doc_id long, digest string, start long, words binary, keys array<long>, ats array<int>"


def _regions(table):
    """Stretches of documents around positions that may hold a benchmark hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "text"):
            rows: list[list] = [[] for _ in _REGIONS]
            words = normal_words(batch.column("text").to_pylist())
            sizes = np.array([len(h) for h in words])
            everything = np.concatenate(words)
            ends = np.cumsum(sizes)
            hits = []
            for mask, key in zip(MASKS, seeds(everything), strict=True):
                at = np.flatnonzero(maybe_in(table.value, key))
                doc = np.searchsorted(ends, at, side="right")
                inside = at + len(mask) <= ends[doc]
                hits.append((at[inside], doc[inside], key[at[inside]]))
            at, doc, key = map(np.concatenate, zip(*hits, strict=True))
            order = np.argsort(at, kind="stable")
            at, doc, key = at[order], doc[order], key[order]
            fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (np.diff(at) > 2 * REACH)])) if len(at) else []
            ids, digests = batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()
            for a, b in zip(fresh, np.append(fresh[1:], len(at)) if len(at) else [], strict=True):
                d = doc[a]
                low = ends[d] - sizes[d]
                start, stop = max(low, at[a] - REACH), min(ends[d], at[b - 1] + max(map(len, MASKS)) + REACH)
                for column, value in zip(rows, (ids[d], digests[d], int(start - low), everything[start:stop].tobytes(),
                                                key[a:b].view(np.int64), (at[a:b] - start).astype(np.int32)), strict=True):
                    column.append(value)
            if rows[0]:
                yield record(_REGIONS, *rows)
    return run


_FOUND = pa.schema([("region", pa.int64()), ("item_id", pa.int64()), ("at", pa.int64()), ("words", pa.int64()),
                    ("same_words", pa.int64())])


def _verify(similarity: float, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "words", 4 << 20):
            rows: list[list] = [[] for _ in _FOUND]
            for region, item_id, diagonal, text, item in zip(*[batch.column(c).to_pylist() for c in (
                    "region", "item_id", "diagonal", "words", "item")], strict=True):
                text, item = np.frombuffer(text, dtype=_U), np.frombuffer(item, dtype=_U)
                low, high = max(0, diagonal), min(len(text), diagonal + len(item))
                same = text[low:high] == item[low - diagonal: high - diagonal]
                a, b = longest_overlap(same, similarity)
                if b - a >= min(min_words, len(item)):
                    for column, value in zip(rows, (region, item_id, low + a, b - a, int(same[a:b].sum())), strict=True):
                        column.append(value)
            yield record(_FOUND, *rows)
    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, digest, item_id, start, words, same_words``: per document row and benchmark
    item the longest overlap (the first, if several), counted in words between white
    space and ASCII punctuation, lower-cased.

    Items of equal words are one item, the smallest item_id. Items of fewer than five
    words have no hash and are not looked for; null texts have no words. ``digest`` is
    the MD5 of the row's text: rows of equal doc_id and text give one result. An empty
    table on either side gives an empty result.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary").alias("text"))
    items = items.mapInArrow(_items, "item_id long, words binary, keys array<long>, ats array<int>")
    items = stored(items.groupBy("words").agg(F.min("item_id").alias("item_id"), F.first("keys").alias("keys"),
                                              F.first("ats").alias("ats")), "benchmark")
    keys = items.select("item_id", F.explode(F.arrays_zip("keys", "ats")).alias("k")).select(
        "item_id", F.col("k.keys").alias("key"), F.col("k.ats").alias("item_at"))
    table = spark.sparkContext.broadcast(bit_table(keys.select("key").distinct(), TABLE_BITS))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("digest"),
                       F.lower(text).cast("binary").alias("text"))
    regions = stored(rows.mapInArrow(_regions(table), REGIONS), "regions")
    regions = regions.withColumn("region", F.monotonically_increasing_id())   # over written files: stable
    hits = regions.select("region", F.explode(F.arrays_zip("keys", "ats")).alias("k")).select(
        "region", F.col("k.keys").alias("key"), F.col("k.ats").alias("at"))
    candidates = hits.join(keys, "key").select("region", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    laid = candidates.join(items.select("item_id", F.col("words").alias("item")), "item_id").join(
        regions.select("region", "words"), "region")
    found = laid.mapInArrow(_verify(similarity, min_words),
                            T.StructType([T.StructField(n, T.LongType()) for n in _FOUND.names]))
    best = found.join(regions.select("region", "doc_id", "digest", F.col("start").alias("from")), "region")
    longest = F.min(F.struct((-F.col("words")).alias("order"), (F.col("from") + F.col("at")).alias("start"), "words", "same_words"))
    return best.groupBy("doc_id", "digest", "item_id").agg(longest.alias("b")).select(
        "doc_id", "digest", "item_id", "b.start", "b.words", "b.same_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, all columns as they were."""
    leaked = overlaps(docs, benchmark, **options).select("doc_id", "digest").distinct()
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), digest.alias("of"))
    kept = rows.join(leaked, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("digest")), "left_anti")
    return kept.select(*unpacked(kept))
