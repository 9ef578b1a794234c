"""Toxicity: a linear classifier of character n-grams scaled by log-count ratios.

A feature says whether a character n-gram (hashed) occurs in the whole text; its
value is the n-gram's naive Bayes log-count ratio between the classes, and logistic
regression learns the weights on top. Document frequencies are counted in Spark;
the n-grams that tell the classes apart best (likelihood ratio) are kept. The model
is of fixed size, so it goes to every task whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsilt.llm.common import _powers, fixed, record, some_rows

ORDERS = (3, 4, 5, 6)
BITS = 20                  # n-grams are hashed to 2 ** BITS buckets
FEATURES = 2048            # n-grams that the classifier keeps
SAMPLE_ROWS = 16_000       # at most so many labelled documents are learnt from
THRESHOLD = 0.7
CHARS = 1 << 18            # characters hashed at once
BLOCK_FEATURES = 1 << 18   # features widened at once
_PARTS = 64
_U = np.uint64


def characters(text: bytes) -> np.ndarray:
    """Code points of a lower-cased text, white space as blanks."""
    return np.frombuffer(" ".join(["", *text.decode("utf-8", "replace").lower().split(), ""]).encode("utf-32-le"),
                         dtype=np.uint32)


def gram_buckets(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per order the bucket of the n-gram that starts at each character."""
    up, down = _powers(1 << 20)
    sums = np.zeros(len(codes) + 1, dtype=_U)
    np.cumsum((codes.astype(_U) + _U(1)) * up[: len(codes)], out=sums[1:])
    for n in ORDERS:
        if len(codes) >= n:
            h = (sums[n:] - sums[:-n]) * down[: len(codes) - n + 1]
            h ^= h >> _U(32)
            yield n, ((h * _U(0xD6E8FEB86659FD93 + 2 * n)) >> _U(64 - BITS)).astype(np.int64)


def chunks(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Overlapping stretches that hold every n-gram of a long text."""
    reach = max(ORDERS) - 1
    for at in range(0, max(1, len(codes) - reach), CHARS):
        yield codes[at: at + CHARS + reach]


def present(text: bytes, seen: np.ndarray) -> np.ndarray:
    """The buckets of a text's n-grams, each once. ``seen`` is scratch space."""
    for part in chunks(characters(text)):
        for _, b in gram_buckets(part):
            seen[b] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


@dataclass
class Model:
    """``index[bucket]``: the feature of a bucket, or -1; ``weight``: ratio times learnt weight."""
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        group, size = [], 0
        for i, text in enumerate(texts):
            codes = characters(text)
            if len(codes) > CHARS:
                found = [self.index[b] for part in chunks(codes) for _, b in gram_buckets(part)]
                found = np.unique(np.concatenate(found))
                total[i] += self.weight[found[found >= 0]].sum()
                continue
            if size + len(codes) > CHARS and group:
                self._add(total, group)
                group, size = [], 0
            group.append((i, codes))
            size += len(codes)
        if group:
            self._add(total, group)
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))

    def _add(self, total: np.ndarray, group: list[tuple[int, np.ndarray]]) -> None:
        ends = np.cumsum([len(c) for _, c in group])
        hits = []
        for n, b in gram_buckets(np.concatenate([c for _, c in group])):
            f = self.index[b]
            at = np.flatnonzero(f >= 0)
            doc = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[doc]
            hits.append(doc[inside] * len(self.weight) + f[at[inside]])
        if hits and (hit := np.unique(np.concatenate(hits))).size:
            sums = np.bincount(hit // len(self.weight), self.weight[hit % len(self.weight)], minlength=len(group))
            total[[i for i, _ in group]] += sums


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    seen = np.zeros(1 << BITS, dtype=bool)
    n = np.zeros(2, dtype=np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            counts[label, present(text, seen)] += 1
            n[label] += 1
    if n.any():
        schema = pa.schema([("part", pa.int32()), ("counts", pa.binary()), ("neg", pa.int64()), ("pos", pa.int64())])
        parts = np.split(counts, _PARTS, axis=1)
        yield record(schema, list(range(_PARTS)), [p.tobytes() for p in parts],
                     [int(n[0]), *[0] * (_PARTS - 1)], [int(n[1]), *[0] * (_PARTS - 1)])


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, dtype=np.int64) for b in table.column("counts").to_pylist())
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary()),
                     "neg": pa.array([sum(table.column("neg").to_pylist())], pa.int64()),
                     "pos": pa.array([sum(table.column("pos").to_pylist())], pa.int64())})


def _ratio(counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of each bucket and its likelihood-ratio statistic."""
    rate = (counts + 1.0) / (n[:, None] + 2.0)
    ratio = np.log(rate[1]) - np.log(rate[0])
    both = (counts.sum(axis=0) + 1.0) / (n.sum() + 2.0)
    gain = sum(counts[c] * np.log(rate[c] / both) + (n[c] - counts[c]) * np.log((1 - rate[c]) / (1 - both)) for c in (0, 1))
    return ratio, gain


def _best(parts: list, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that tell the classes apart best, and their ratios; the driver works on one part at a time."""
    ratio, gain = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in parts:
        counts = np.frombuffer(r.counts, dtype=np.int64).reshape(2, -1)
        at = slice(r.part * counts.shape[1], (r.part + 1) * counts.shape[1])
        ratio[at], gain[at] = _ratio(counts, n)
    some = np.flatnonzero((gain > 0) & (gain >= np.partition(gain, -FEATURES)[-FEATURES]))
    best = some[np.lexsort((some, -gain[some]))][:FEATURES]
    return best, ratio[best]


def logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, l2: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on rows that list their present features, each with the
    value ``scale``; full-batch Adam, deterministic. Features stay as narrow as they came and are widened some
    rows at a time, as the driver learns; sums run in the order of the rows all the same."""
    sizes = np.array([len(r) for r in rows])
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_FEATURES)) + 1).tolist(), len(rows)]
    blocks = [(a, b, np.concatenate(rows[a:b])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    own = np.arange(len(scale))
    w, bias = np.zeros(len(scale)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        value, total, e = w * scale, np.zeros(len(w)), np.zeros(len(rows))
        for a, b, flat in blocks:
            row = np.repeat(np.arange(b - a), sizes[a:b])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value[flat], minlength=b - a) + bias, -50, 50)))
            e[a:b] = p - y[a:b]
            total = np.bincount(np.concatenate([own, flat]), np.concatenate([total, e[a:b][row]]), minlength=len(w))
        g = np.append((total * scale + l2 * w) / len(y), e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def train(labelled: DataFrame) -> Model:
    """Learn from ``labelled(text binary, label int 0/1)``. Nothing to learn from: every
    text scores 0; one class only: the smoothed share of label 1."""
    counted = labelled.mapInArrow(_frequencies, "part int, counts binary, neg long, pos long")
    got = counted.groupBy("part").applyInArrow(_summed, "part int, counts binary, neg long, pos long").collect()
    index = np.full(1 << BITS, -1, dtype=np.int16)
    if not got:
        return Model(index, np.zeros(1), -50.0)
    n = np.array([sum(r.neg for r in got), sum(r.pos for r in got)])
    if not n.all():
        return Model(index, np.zeros(1), float(np.log((n[1] + 1) / (n[0] + 1))))
    best, ratio = _best(got, n)
    del got
    index[best] = np.arange(len(best))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            rows = [index[present(t, seen)] for t in batch.column("text").to_pylist()]
            yield record(pa.schema([("label", pa.int32()), ("features", pa.binary())]), batch.column("label"),
                         [r[r >= 0].tobytes() for r in rows])

    rows = labelled.mapInArrow(features, "label int, features binary").collect()  # at most SAMPLE_ROWS short rows
    rows.sort(key=lambda r: (r.label, r.features))  # sums in one order, whatever task came first
    w, bias = logistic([np.frombuffer(r.features, dtype=np.int16) for r in rows], np.array([r.label for r in rows], dtype=float),
                       ratio)
    return Model(index, w * ratio, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, label`` of at most ``sample_rows`` labelled documents, drawn by a hash of
    doc_id. A document that any label calls toxic is toxic; null labels say nothing.
    The drawn ids are few by that bound, so they are broadcast."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label"))
             .filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
             .orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    texts = fixed(docs, id=F.col("doc_id").cast("long"), text=F.col("text").cast("binary")).filter("text is not null")
    return texts.join(F.broadcast(marks), "id").select("text", "label")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``docs(doc_id, text)`` by its whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "text", 4 << 20):
            yield record(schema, batch.column("doc_id"), shipped.value.scores(batch.column("text").to_pylist()))

    rows = fixed(docs, doc_id=F.col("doc_id").cast("long"), text=F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, learn_from=None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``; ``learn_from`` restricts the
    labelled rows. Null and empty texts are scored as empty; repeated rows each."""
    known = labels if learn_from is None else labels.filter(learn_from)
    model = train(labelled_sample(docs, known))
    return score(docs, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; a null text stays.
    Filtering happens in the scoring pass: no join back, no shuffle of texts."""
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels)))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "text", 4 << 20):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            keep = model.value.scores(texts) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
