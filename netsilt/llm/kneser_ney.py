"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped.

Counting: a task turns its documents into 64-bit word hashes, counts its n-grams
and sends one packed row per bucket of contexts. A bucket's task sums them, so a
frequent n-gram costs a record per task. It writes the n-grams as arrays sorted by hash
(hash, count; and per context hash its total and how many n-grams occur once, twice, more
often) and sends the types of the next lower order on, whose counts are thus
continuation counts. Nothing is pruned.

Storage: array files in the shared folder. Workers map them into memory, so a model
larger than memory is paged from disk, and all workers of a host share the pages.
The folder must be mounted as a file system on every executor.

Scoring: probabilities are worked out from the counts when looked up.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsilt.llm.common import as_bytes, chain, fixed, new_folder, record, share, some_rows, stored, word_hashes

ORDER = 2
BUCKET_BYTES = 12 << 20      # of training text per bucket
LEAST_BUCKETS = 48
FLUSH_TOKENS = 1_500_000     # a task counts so many tokens at once
_U = np.uint64
_MASK = _U((1 << 48) - 1)    # n-grams carry 48 bits of their words' hashes
BEGIN, END = _U(0x5BD1E9955BD1), _U(0x27D4EB2F165667C5)


def local_path(folder: str) -> str:
    """The mounted path of a folder; what is not mounted cannot be mapped."""
    if "://" in folder or folder.startswith("file:"):
        scheme, _, rest = folder.partition(":")
        if scheme != "file":
            raise ValueError(f"{folder}: memory-mapped models need spark.checkpoint.dir on a mounted file system")
        return "/" + rest.lstrip("/")
    return folder


def _narrow(a: np.ndarray) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(blobs: list[bytes]) -> np.ndarray:
    six = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), dtype=np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def sequences(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of all texts' tokens: word hashes (64 bits), the hashes of the 1, ..., order-1
    words before (48 bits), and tokens per text. Each text ends in END and is
    preceded by BEGINs."""
    parts, sizes, pad = [], [], np.full(order - 1, BEGIN, dtype=_U)
    for h in word_hashes([t.lower() for t in texts]):
        parts += [pad, h, np.array([END], dtype=_U)]
        sizes.append(len(h) + 1)
    sizes = np.array(sizes, dtype=np.int64)
    row = np.concatenate(parts) if parts else np.zeros(0, dtype=_U)
    token = np.repeat(np.arange(len(sizes)) * (order - 1) + order - 1, sizes) + np.arange(sizes.sum())
    contexts, short = [row[token - 1] & _MASK], row & _MASK
    for j in range(2, order):
        contexts.append(chain(contexts[-1], short[token - j]) & _MASK)
    return row[token], contexts[: order - 1], sizes


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by the columns (first is major), and the starts of equal rows."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[order[1:]] != c[order[:-1]]
    return order, np.flatnonzero(fresh)


_SENT = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()),
                   ("contexts", pa.list_(pa.binary())), ("counts", pa.binary())])
SENT = "level int, bucket int, words binary, contexts array<binary>, counts binary"


def _packed(level: int, words: np.ndarray, contexts: list[np.ndarray], counts: np.ndarray, buckets: int,
            whole: bool = False) -> pa.RecordBatch:
    """One row per bucket of the longest context, or of the word where there is none."""
    bucket = ((contexts[-1] if contexts else words & _MASK) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    cut = lambda a, f: [f(a[order[cuts[k]: cuts[k + 1]]]) for k in full]
    columns = [cut(c, _narrow) for c in contexts]
    return record(_SENT, np.full(len(full), level, np.int32), full.astype(np.int32),
                  cut(words, (lambda a: a.tobytes()) if whole else _narrow),
                  [[c[k] for c in columns] for k in range(len(full))], cut(counts.astype("<u4"), lambda a: a.tobytes()))


def _count(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = np.concatenate([w for w, _ in held])
            contexts = [np.concatenate(c) for c in zip(*[c for _, c in held], strict=True)]
            words &= _MASK
            at, first = _groups(contexts[-1], words)
            counts = np.diff(np.append(first, len(at)))
            at = at[first]
            yield _packed(order, words[at], [c[at] for c in contexts], counts, buckets)

        for batch in some_rows(batches, "text", 2 << 20):
            words, contexts, _ = sequences(batch.column("text").to_pylist(), order)
            held.append((words, contexts))
            size += len(words)
            if size >= FLUSH_TOKENS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()
    return run


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in some_rows(batches, "text", 2 << 20):
            held.append(sequences(batch.column("text").to_pylist(), 2)[0])
            size += len(held[-1])
            if size >= FLUSH_TOKENS:
                yield _packed(0, *_with_counts(held), buckets, whole=True)
                held, size = [], 0
        if size:
            yield _packed(0, *_with_counts(held), buckets, whole=True)
    return run


def _with_counts(held: list[np.ndarray]) -> tuple[np.ndarray, list, np.ndarray]:
    known, counts = np.unique(np.concatenate(held), return_counts=True)
    return known, [], counts


_BUILT = pa.schema([*_SENT, ("stats", pa.list_(pa.int64()))])
BUILT = SENT + ", stats array<long>"


def _save(path: str, array: np.ndarray) -> None:
    """Write beside and rename, so that a repeated task leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "wb") as f:
        np.save(f, array)
    os.replace(beside, path)


def _often(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _build(level: int, folder: str, buckets: int):
    """A bucket of n-grams of order ``level`` >= 2: write its arrays, pass its types on."""
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        words = _wide(table.column("words").to_pylist())
        contexts = [_wide(list(c)) for c in zip(*table.column("contexts").to_pylist(), strict=True)]
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype="<u4").astype(np.int64)
        at, first = _groups(contexts[-1], words)
        counts = np.add.reduceat(counts[at], first)
        at = at[first]
        words, contexts = words[at], [c[at] for c in contexts]
        keys = chain(contexts[-1], words)
        order = np.argsort(keys)
        _save(f"{folder}/{level}/{bucket}-keys.npy", keys[order])
        _save(f"{folder}/{level}/{bucket}-counts.npy", counts[order].astype("<u4"))
        of = np.flatnonzero(np.concatenate([[True], contexts[-1][1:] != contexts[-1][:-1]]))
        _save(f"{folder}/{level}/{bucket}-contexts.npy", contexts[-1][of])
        table_of = [np.add.reduceat(x.astype(np.int64), of) for x in (counts, counts == 1, counts == 2, counts > 2)]
        _save(f"{folder}/{level}/{bucket}-totals.npy", np.stack(table_of, axis=1))
        lower = contexts[:-1]
        at, first = _groups(*lower[::-1], words)
        types = np.diff(np.append(first, len(at)))
        at = at[first]
        sent = _packed(level - 1, words[at], [c[at] for c in lower], types, buckets)
        out = pa.Table.from_batches([sent]).append_column("stats", pa.nulls(sent.num_rows, pa.list_(pa.int64())))
        stats = record(_BUILT, [-level], [bucket], [None], [None], [None], [_often(counts)])
        return pa.concat_tables([out.cast(_BUILT), pa.Table.from_batches([stats])])
    return run


def _build_words(folder: str):
    """A bucket of words: counts in the text and continuation counts."""
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts: dict[int, list] = {0: [], 1: []}
        for level, words, counts in zip(*[table.column(c).to_pylist() for c in ("level", "words", "counts")], strict=True):
            parts[level].append((words, np.frombuffer(counts, dtype="<u4").astype(np.int64)))
        words = np.frombuffer(b"".join([w for w, _ in parts[0]]), dtype="<u8")
        counts = np.concatenate([c for _, c in parts[0]] or [np.zeros(0, np.int64)])
        known, inverse = np.unique(words, return_inverse=True)
        total = np.bincount(inverse, counts, minlength=len(known)).astype(np.int64)
        short = _wide([w for w, _ in parts[1]])
        types = np.concatenate([c for _, c in parts[1]] or [np.zeros(0, np.int64)])
        ends, inverse = np.unique(short, return_inverse=True)
        types = np.bincount(inverse, types, minlength=len(ends)).astype(np.int64)
        _save(f"{folder}/1/{bucket}-keys.npy", known)
        _save(f"{folder}/1/{bucket}-counts.npy", total)
        at = np.minimum(np.searchsorted(ends, known & _MASK), max(0, len(ends) - 1))
        follows = np.where(ends[at] == known & _MASK, types[at], 0) if len(ends) else np.zeros(len(known), np.int64)
        _save(f"{folder}/1/{bucket}-follows.npy", follows)
        stats = [*_often(follows), int((follows > 0).sum()), int(follows.sum()), len(known), int(total.sum())]
        return pa.table([[-1], [bucket], [None], [None], [None], [stats]], schema=_BUILT)
    return run


def discounts(often: list[int]) -> np.ndarray:
    """D1, D2, D3+ from how many n-grams occur once to four times; where these say
    nothing (a zero among them), half of the count up to 1.5."""
    n1, n2, n3, n4 = often
    if min(n1, n2, n3) == 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *[min(max(x, 0.01 * k), k) for k, x in enumerate(d, 1)]])


@lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray | None:
    if not os.path.exists(path):
        return None
    a = np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)
    return a


@dataclass
class Model:
    """Where the arrays are, and the few numbers that concern all of them."""
    folder: str
    order: int
    buckets: int
    discount: dict[int, np.ndarray]
    tokens: int          # N: training tokens
    words: int           # V: distinct ones
    types: int           # n-grams of the lowest counted order
    spare: float         # share of mass the lowest order gives to all words alike

    def _find(self, level: int, select: np.ndarray, keys: np.ndarray, sorted_by: str, *names: str) -> list[np.ndarray]:
        """Rows of the files ``names`` for ``keys``; zeros where a key is unknown."""
        out: list = [None] * len(names)
        bucket = (select % _U(self.buckets)).astype(np.int64)
        order = np.lexsort((keys, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[b]: cuts[b + 1]]
            known = _mapped(f"{self.folder}/{level}/{b}-{sorted_by}.npy")
            if known is None or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
            hit = known[at] == keys[rows]
            for k, name in enumerate(names):
                values = _mapped(f"{self.folder}/{level}/{b}-{name}.npy")
                if out[k] is None:
                    out[k] = np.zeros((len(keys), *values.shape[1:]), dtype=np.int64)
                out[k][rows[hit]] = values[at[hit]]
        return [np.zeros((len(keys), 4) if n == "totals" else len(keys), np.int64) if o is None else o
                for o, n in zip(out, names, strict=True)]

    def probabilities(self, words: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each word after its context, and its count in the training text."""
        counts, follows = self._find(1, words & _MASK, words, "keys", "counts", "follows")
        d = self.discount[1]
        p = np.full(len(words), self.spare / (self.words + 1))
        if self.types:
            p += np.maximum(follows - d[np.minimum(follows, 3)], 0) / self.types
        short = words & _MASK
        for level in range(2, self.order + 1):
            c, d = contexts[level - 2], self.discount[level]
            seen, = self._find(level, c, chain(c, short), "keys", "counts")
            total, = self._find(level, c, c, "contexts", "totals")
            known = total[:, 0] > 0
            whole = np.maximum(total[:, 0], 1)
            back = total[:, 1:] @ d[1:] / whole
            p = np.where(known, np.maximum(seen - d[np.minimum(seen, 3)], 0) / whole + back * p, p)
        return p, counts


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count all of ``docs(text)``; null texts are empty and have their end alone."""
    if order < 2:
        raise ValueError("order is at least 2")
    texts = fixed(docs, text=as_bytes("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = share(size, BUCKET_BYTES, LEAST_BUCKETS)
    shared = new_folder(docs.sparkSession, "kneser-ney")
    folder = local_path(shared)
    rows, stats = texts.mapInArrow(_count(order, buckets), SENT), []
    for level in range(order, 1, -1):
        built = stored(rows.filter(F.col("level") == level).groupBy("bucket").applyInArrow(
            _build(level, folder, buckets), BUILT), "ngrams")
        stats += built.filter("level < 0").select("level", "stats").collect()   # a row per bucket
        rows = built.drop("stats")
    both = rows.filter("level = 1").unionByName(texts.mapInArrow(_count_words(buckets), SENT))
    stats += both.groupBy("bucket").applyInArrow(_build_words(folder), BUILT).select("level", "stats").collect()
    sums = {k: np.sum([r.stats for r in stats if r.level == -k], axis=0).tolist() or [0] * 8 for k in range(1, order + 1)}
    sums = {k: v if isinstance(v, list) else [0] * 8 for k, v in sums.items()}
    discount = {k: discounts(v[:4]) for k, v in sums.items()}
    n1, n2, _, _, kinds, types, words, tokens = sums[1]
    spare = (discount[1][1:] @ [n1, n2, kinds - n1 - n2]) / types if types else 1.0
    return Model(folder, order, buckets, discount, tokens, words, types, float(spare))


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: tokens, those the model has seen, and the text's
    log10 probability by word frequency alone and by the model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "text", 2 << 20):
            words, contexts, sizes = sequences(batch.column("text").to_pylist(), model.order)
            p, counts = model.probabilities(words, contexts)
            base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            yield record(_SCORES, batch.column("doc_id"), sizes, np.add.reduceat((counts > 0).astype(np.int64), first),
                         np.full(len(sizes), model.tokens), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first))

    rows = fixed(docs, doc_id=F.col("doc_id").cast("long"), text=as_bytes("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_model_scores(docs: DataFrame, learn_from: Column, order: int = ORDER) -> DataFrame:
    """Learn from the rows of ``docs`` where ``learn_from`` holds, score every row. Repeated
    rows count and are scored each; nothing to learn from gives probability 1 to all."""
    return score(docs, train(docs.filter(learn_from), order))
