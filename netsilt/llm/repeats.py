"""Substring deduplication: remove passages that an earlier document already has.

A word goes if a window of ``WINDOW`` = 50 words over it also starts in a document
with a smaller doc_id.

1. *Recurring phrases.* In any window the 25-word phrase with the smallest hash is a
   landmark; equal windows have equal landmarks. Landmarks are counted over all
   documents (about one word in thirteen, merged per task first); those of a single
   document are dropped, and with them almost all unrepeated text.
2. *Confirmed passages.* Windows with a recurring landmark are grouped by their own
   hash. A task settles what it can among its own documents and sends one record
   per window on, so a passage that a third of all documents share makes one
   record per task. Rows with the doc_id of the row sent share all that is found for
   it. The result says which stretch of which earlier document a document shares.
3. *Automata.* Documents are dealt into shards of bounded size. A shard fetches the
   text of its shared stretches from the earlier documents, cuts them into 25-word
   tiles (every 50-word window inside a stretch holds a whole one), compiles the tiles into
   an Aho-Corasick automaton over words, and streams its documents through it. Each
   occurrence is extended word by word; windows that agree in full are removed.

So hashes only choose candidates; what is removed is equal word for word to the text
of a document with a smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsilt.llm.bloom import bit_table, maybe_in
from netsilt.llm.common import _powers, mix, record, share, some_rows, stored, word_hashes, whole_row

WINDOW = 50
LAST = (1 << 63) - 1        # stands for a null doc_id: after all others
GROUP_WINDOWS = 1_000_000   # windows a task settles at once
BUCKET_WORDS = 2_000_000    # words of candidate text per bucket of step 2
SHARD_WORDS = 400_000       # words of documents per automaton
LEAST = 24                  # buckets and shards at least
TIED = -1                   # instead of a place: the row sent on has the same doc_id
_U = np.uint64


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that start at each position."""
    if len(h) < n:
        return np.zeros(0, dtype=_U)
    up, down = _powers(max(1 << 20, 1 << len(h).bit_length()))
    sums = np.zeros(len(h) + 1, dtype=_U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1] + _U(n))


def landmarks(h: np.ndarray, window: int) -> np.ndarray:
    """Per window the smallest hash of its phrases of half the window."""
    least = rolling(h, window // 2)
    width, wide = 1, window - window // 2 + 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (wide - width)], least[wide - width:]) if wide > width else least


_MARKS = pa.schema([("mark", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _marks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "text"):
            each = [np.unique(landmarks(h, window)) if len(h) >= window else h[:0]
                    for h in word_hashes([t or b"" for t in batch.column("text").to_pylist()])]
            mark = np.concatenate(each)
            key = np.repeat(batch.column("key").to_numpy(), [len(e) for e in each])
            order = np.lexsort((key, mark))
            mark, key = mark[order], key[order]
            if len(mark):
                first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
                last = np.append(first[1:], len(mark)) - 1
                yield record(_MARKS, mark[first].view(np.int64), key[first], key[last])
    return run


def _flagged(window: int, table, wanted: bool):
    """Rows that may (or cannot) hold a recurring window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "text"):
            hashes = word_hashes([t or b"" for t in batch.column("text").to_pylist()])
            flag = [len(h) >= window and bool(maybe_in(table.value, landmarks(h, window)).any()) for h in hashes]
            words = pa.array([len(h) for h in hashes], pa.int64())
            out = pa.RecordBatch.from_arrays([*batch.columns, words], names=[*batch.schema.names, "n_words"])
            yield out.filter(pa.array([f == wanted for f in flag]))
    return run


_SENT = pa.schema([("bucket", pa.int32()), ("window", pa.binary()), ("key", pa.binary()), ("rid", pa.binary()),
                   ("at", pa.binary()), ("shared", pa.binary())])
SENT = "bucket int, window binary, key binary, rid binary, at binary, shared binary"


def _settle(window, key, rid, at):
    """Among records of windows: the first document's record of each window, and for the
    others with a larger doc_id rows (rid, first's rid, place in first), for other rows
    of the same doc_id (rid, first's rid, TIED)."""
    order = np.lexsort((at, rid, key, window))
    window, key, rid, at = window[order], key[order], rid[order], at[order]
    head = np.concatenate([[True], window[1:] != window[:-1]]) if len(window) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    owner = np.repeat(first, np.diff(np.append(first, len(window))))
    later = key > key[owner]
    tied = np.flatnonzero((key == key[owner]) & (rid != rid[owner]))
    links = np.stack([rid[later], rid[owner[later]], at[owner[later]]], axis=1)
    ties = np.stack([rid[tied], rid[owner[tied]], np.full(len(tied), TIED)], axis=1)
    return first, (window[first], key[first], rid[first], at[first]), order, links, ties


def _windows(size: int, table, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            bucket, window, key, rid, at = map(np.concatenate, zip(*held, strict=True))
            first, (window, key, rid, at), order, *shared = _settle(window, key, rid, at)
            bucket = bucket[order][first]
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            cut = lambda a: [a[order[cuts[k]: cuts[k + 1]]].tobytes() for k in full]
            # what is settled here rides along, spread over the records
            shared = np.unique(np.concatenate(shared), axis=0).astype(np.int64)
            part = (mix(shared[:, 0].astype(_U)) % _U(len(full))).astype(np.int64)
            settled = [shared[part == k].tobytes() for k in range(len(full))]
            yield record(_SENT, full.astype(np.int32), cut(window), cut(key), cut(rid), cut(at.astype(np.uint32)), settled)

        for batch in some_rows(batches, "text"):
            for h, key, rid in zip(word_hashes([t or b"" for t in batch.column("text").to_pylist()]),
                                   batch.column("key").to_pylist(), batch.column("rid").to_pylist(), strict=True):
                mark = landmarks(h, size)
                at = np.flatnonzero(maybe_in(table.value, mark))
                held.append(((mix(mark[at]) % _U(buckets)).astype(np.int32), rolling(h, size)[at],
                             np.full(len(at), key), np.full(len(at), rid), at))
                count += len(at)
                if count >= GROUP_WINDOWS:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()
    return run


_SHARED = pa.schema([("rid", pa.int64()), ("owner", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])


def _shared(table: pa.Table) -> pa.Table:
    get = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)
    *_, shared, _ = _settle(get("window", _U), get("key", np.int64), get("rid", np.int64), get("at", np.uint32).astype(np.int64))
    shared = np.unique(np.concatenate([shared, get("shared", np.int64).reshape(-1, 3)]), axis=0)
    run = np.ones(len(shared), dtype=bool)   # starts of runs of neighbouring windows
    run[1:] = (np.diff(shared[:, :2], axis=0) != 0).any(axis=1) | (np.diff(shared[:, 2]) != 1)
    first = np.flatnonzero(run)
    return pa.table([*shared[first].T, np.diff(np.append(first, len(shared)))], schema=_SHARED)


_PASSAGES = pa.schema([("shard", pa.int64()), ("docs", pa.list_(pa.int64())), ("passages", pa.list_(pa.binary()))])


def _passages(size: int):
    """Text of the stretches asked for, neighbouring ones joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "text"):
            out = []
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words, merged = text.split(), []
                for a, b in sorted((r["start"], r["start"] + r["windows"] + size - 1) for r in asked):
                    # joined only where a whole window spans the seam
                    if merged and a <= merged[-1][1] - size + 1:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                out.append([b" ".join(words[a:b]) for a, b in merged])
            yield record(_PASSAGES, batch.column("shard"), batch.column("docs"), out)
    return run


class Tiles:
    """The automaton of one shard: 25-word tiles of its passages, over word numbers."""

    def __init__(self, passages: list[tuple[list[int], list[bytes]]], window: int):
        self.window, self.tile = window, window // 2
        self.numbers: dict[bytes, int] = {}
        self.passages, self.owner, self.owners = [], [], {}
        at: dict[tuple, list] = {}
        for o, (docs, texts) in enumerate(passages):
            for d in docs:
                self.owners.setdefault(d, set()).add(o)
            for text in texts:
                ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.split()]
                for k in range(0, len(ids) - self.tile + 1, self.tile):
                    at.setdefault(tuple(ids[k: k + self.tile]), []).append((len(self.passages), k))
                self.passages.append(np.array(ids, dtype=np.int64))
                self.owner.append(o)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for tile, places in at.items():
            self.automaton.add_word(tile, places)
        self.automaton.make_automaton()

    def removed(self, doc: int, words: list[bytes]) -> np.ndarray:
        """Which words lie in a window of one of the document's earlier passages."""
        gone = np.zeros(len(words), dtype=bool)
        owners, tile, reach = self.owners.get(doc), self.tile, self.window - self.tile
        if not owners:
            return gone
        get = self.numbers.get
        ids = tuple([get(w, 0) for w in words])
        array = np.array(ids, dtype=np.int64)
        for end, places in self.automaton.iter(ids):
            x = end - tile + 1
            low, high = max(0, x - reach), min(len(ids), x + tile + reach)
            for p, k in places:
                if self.owner[p] not in owners:
                    continue
                if gone[low:high].all():
                    break
                passage = self.passages[p]
                left, right = min(x - low, k), min(high - x, len(passage) - k)
                differs = np.flatnonzero(array[x - left: x + right] != passage[k - left: k + right]) - left
                before, after = differs[differs < 0], differs[differs >= tile]
                a, b = x + (before[-1] + 1 if len(before) else -left), x + (after[0] if len(after) else right)
                if b - a >= self.window:
                    gone[a:b] = True
        return gone


def _stream(window: int, names: list[str]):
    def run(docs: pa.Table, passages: pa.Table) -> pa.Table:
        tiles = Tiles(list(zip(passages.column("docs").to_pylist(), passages.column("passages").to_pylist(), strict=True)), window)
        texts, removed = [], []
        for rid, text in zip(docs.column("rid").to_pylist(), docs.column("text").to_pylist(), strict=True):
            words = text.split()
            gone = tiles.removed(rid, words)
            n = int(gone.sum())
            removed.append(n)
            texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if n else text)
        return pa.table([docs.column("row"), pa.chunked_array([pa.array(texts, pa.binary())]), docs.column("n_words"),
                         pa.array(removed, pa.int64())], names=names)
    return run


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row`` (a struct of the other columns of ``docs``), ``text`` (bytes), ``n_words`` and
    ``n_removed`` for every row of ``docs(doc_id, text, ...)``.

    The text of a document that loses words is the kept words joined by one blank; else it
    is as it was. Null text has no words and stays null. Rows of one doc_id count as one
    document: they do not remove from each other. A null doc_id comes after all others.
    """
    spark = docs.sparkSession
    rows = docs.select(whole_row(docs, "text").alias("row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"),
                       F.col("text").cast("binary").alias("text"))
    marks = rows.select("key", "text").mapInArrow(_marks(window), "mark long, low long, high long")
    recurring = marks.groupBy("mark").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high")
    table = spark.sparkContext.broadcast(bit_table(recurring.select("mark")))

    number = lambda name: T.StructField(name, T.LongType())
    counted = T.StructType([*rows.schema.fields, number("n_words")])
    clean = rows.mapInArrow(_flagged(window, table, False), counted)
    # from here on only documents that may share a window
    pending = stored(rows.mapInArrow(_flagged(window, table, True), counted), "repeats")
    pending = pending.withColumn("rid", F.monotonically_increasing_id())   # over written files: stable
    words = pending.agg(F.sum("n_words")).first()[0] or 0

    sent = pending.select("key", "rid", "text").mapInArrow(
        _windows(window, table, share(words, BUCKET_WORDS, LEAST)), SENT)
    shared = stored(sent.groupBy("bucket").applyInArrow(_shared, "rid long, owner long, start long, windows long"),
                    "repeats-shared")
    # a tied row asks for what the row sent on asks for: all of it is text of smaller doc_ids
    ties = shared.filter(F.col("start") == TIED).select("rid", F.col("owner").alias("sent"))
    shared = shared.filter(F.col("start") != TIED)
    shared = shared.unionByName(ties.join(shared.withColumnRenamed("rid", "sent"), "sent").drop("sent"))
    shard = F.pmod(F.xxhash64("rid"), F.lit(share(words, SHARD_WORDS, LEAST)))
    asked = shared.groupBy("owner", shard.alias("shard")).agg(
        F.collect_set("rid").alias("docs"), F.collect_set(F.struct("start", "windows")).alias("runs"))
    passages = asked.join(pending.select(F.col("rid").alias("owner"), "text"), "owner").select(
        "shard", "docs", "runs", "text").mapInArrow(_passages(window), "shard long, docs array<long>, passages array<binary>")
    names = ["row", "text", "n_words", "n_removed"]
    out = T.StructType([pending.schema["row"], pending.schema["text"], number("n_words"), number("n_removed")])
    resolved = pending.select("row", "text", "n_words", "rid", shard.alias("shard")).groupBy("shard").cogroup(
        passages.groupBy("shard")).applyInArrow(_stream(window, names), out)
    return clean.select("row", "text", "n_words", F.lit(0).cast("long").alias("n_removed")).unionByName(resolved)


def documents_without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``; other columns as they were."""
    done = without_repeats(docs, window)
    return done.select(*[F.col("text").cast("string").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c)
                         for c in docs.columns])
