"""Language identification of words by a linear-chain conditional random field.

Each word of a code-switched text gets a label. Its features are the word, its
prefixes and suffixes, its byte n-grams and whether it is among a language's most
frequent words (the lexicon, learnt as well); transitions between the labels of
neighbouring words are learnt. Forward-backward gives every word its posterior;
a document's language is the label with the largest sum over its words.

Labels of whole documents train it: words take their document's language, and half
of the training sequences are spliced from two documents, so that switches occur.
The model is of fixed size. Features are worked out once per distinct word of a batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsilt.llm.common import _powers, fixed, mix, pieces, record, some_rows, spans

STRETCH = 64                # words per sequence; longer texts are several
SAMPLE_DOCUMENTS = 6_000    # at most so many labelled documents are learnt from,
SAMPLE_STRETCHES = 10_000   # and so many of their stretches
LEXICON_WORDS = 100         # per language
BITS = 17                   # features are hashed to 2 ** BITS rows
STEPS = 40
PREFIXES, SUFFIXES, GRAMS = (1, 2, 3), (1, 2, 3, 4), (2, 3)
UNKNOWN = "und"
_U = np.uint64


class Words:
    """The words of a buffer: their hashes and the features of the distinct ones."""

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        self.starts, self.ends = spans(buf)
        up, self.down = _powers(max(1 << 20, 1 << len(buf).bit_length()))
        self.sums = np.zeros(len(buf) + 1, dtype=_U)
        np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=self.sums[1:])
        self.hash = self._range(self.starts, self.ends, 0)
        # words that have a letter; bytes from 128 on belong to one too
        letter = np.concatenate([[0], np.cumsum((buf >= 128) | ((buf >= 97) & (buf <= 122)))])
        self.counts = letter[self.ends] > letter[self.starts]

    def _range(self, a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + _U(kind))

    def features(self, rows: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of the given words, word after word, and where each word's begin."""
        s, e, h = self.starts[rows], self.ends[rows], self.hash[rows]
        columns = [h]
        columns += [self._range(s, np.minimum(s + k, e), 1 + k) for k in PREFIXES]
        columns += [self._range(np.maximum(s, e - k), e, 11 + k) for k in SUFFIXES]
        at = np.minimum(np.searchsorted(lexicon[:, 0], h), max(0, len(lexicon) - 1)) if len(lexicon) else None
        # the lexicon's feature: in which languages' lists the word is
        columns.append(mix(np.where(lexicon[at, 0] == h, lexicon[at, 1], _U(0)) + _U(77)) if at is not None else h * _U(0))
        whole = np.stack(columns, axis=1)
        parts, owners = [whole.ravel()], [np.repeat(np.arange(len(rows)), whole.shape[1])]
        for n in GRAMS:
            sizes = np.maximum(e - s - n + 1, 0)
            first = np.repeat(s - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            parts.append(self._range(first, first + n, 20 + n))
            owners.append(np.repeat(np.arange(len(rows)), sizes))
        index = np.concatenate([(p >> _U(64 - BITS)).astype(np.int32) for p in parts])
        owner = np.concatenate([o.astype(np.int32) for o in owners])
        order = np.argsort(owner, kind="stable")
        return index[order], np.searchsorted(owner[order], np.arange(len(rows)))


def forward_backward(emission: np.ndarray, length: np.ndarray, transition: np.ndarray, start: np.ndarray
                     ) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors (sequence, word, label) of padded sequences, expected transitions summed
    over them, and the log of their partition functions summed."""
    top = emission.max(axis=2, keepdims=True)
    e = np.exp(emission - top)
    a, steps = np.exp(transition), emission.shape[1]
    valid = np.arange(steps)[None, :] < length[:, None]
    alpha, scale = np.zeros_like(e), np.ones(e.shape[:2], dtype=e.dtype)
    for t in range(steps):
        now = e[:, t] * (np.exp(start) if t == 0 else alpha[:, t - 1] @ a)
        total = now.sum(axis=1)
        alpha[:, t], scale[:, t] = now / total[:, None], total
    beta, pairs = np.ones_like(e), np.zeros_like(a)
    for t in range(steps - 2, -1, -1):
        after = e[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
        on = valid[:, t + 1]
        beta[:, t] = np.where(on[:, None], after @ a.T, 1.0)
        pairs += alpha[on, t].T @ after[on]
    posterior = alpha * beta
    posterior /= posterior.sum(axis=2, keepdims=True)
    return posterior * valid[:, :, None], pairs * a, float(((np.log(scale) + top[:, :, 0]) * valid).sum())


@dataclass
class Model:
    labels: list[str]
    weight: np.ndarray       # (feature row, label)
    transition: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray      # sorted hashes and their language bits

    def emissions(self, words: Words) -> np.ndarray:
        _, rows, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        index, first = words.features(rows, self.lexicon)
        return np.add.reduceat(self.weight[index], first, axis=0)[inverse]

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Posteriors of each text's words that have a letter, summed by label."""
        out = np.zeros((len(texts), len(self.labels)))
        group, size = [], 0
        for i, text in enumerate(texts):
            for part in pieces(text):
                if size + len(part) > 1 << 20 and group:
                    self._add(out, group)
                    group, size = [], 0
                group.append((i, part))
                size += len(part) + 1
        if group:
            self._add(out, group)
        return out

    def _add(self, out: np.ndarray, group: list[tuple[int, bytes]]) -> None:
        words = Words(np.frombuffer(b"\n".join([p for _, p in group]) + b"\n", dtype=np.uint8))
        if not len(words.starts):
            return
        ends = np.cumsum([len(p) + 1 for _, p in group])
        doc = np.searchsorted(ends, words.starts, side="right")
        emission = self.emissions(words)
        size = np.bincount(doc, minlength=len(group))
        place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        new = place % STRETCH == 0
        sequence = np.cumsum(new) - 1
        length = np.bincount(sequence)
        step = place % STRETCH
        for a in range(0, len(length), 2048):
            some = (sequence >= a) & (sequence < a + 2048)
            padded = np.zeros((min(2048, len(length) - a), int(length[a: a + 2048].max()), emission.shape[1]), dtype=np.float32)
            padded[sequence[some] - a, step[some]] = emission[some]
            posterior, _, _ = forward_backward(padded, length[a: a + 2048], self.transition, self.start)
            of = posterior[sequence[some] - a, step[some]] * words.counts[some][:, None]
            which = np.array([i for i, _ in group])[doc[some]]
            for k in range(len(self.labels)):
                out[:, k] += np.bincount(which, of[:, k], minlength=len(out))


def _lexicon(words: Words, label: np.ndarray, labels: int) -> np.ndarray:
    """The most frequent words of each language, as (hash, bits of the languages)."""
    bits: dict[int, int] = {}
    for k in range(labels):
        known, counts = np.unique(words.hash[(label == k) & words.counts], return_counts=True)
        for h in known[np.lexsort((known, -counts))][:LEXICON_WORDS].tolist():
            bits[h] = bits.get(h, 0) | 1 << (k % 63)
    return np.array(sorted(bits.items()), dtype=_U).reshape(-1, 2)


def fit(stretches: list[tuple[str, bytes]], steps: int = STEPS, l2: float = 0.1) -> Model:
    """Learn from (language, text of one stretch); full-batch Adam, deterministic. Each odd
    stretch is spliced: its second half changes places with that of its neighbour."""
    labels = sorted({lang for lang, _ in stretches})
    texts, marks = [], []
    for k, (lang, text) in enumerate(stretches):
        words = text.split()[:STRETCH]
        texts.append(words)
        marks.append([labels.index(lang)] * len(words))
    for k in range(0, len(texts) - 3, 4):
        i, j = (len(texts[k]) + 1) // 2, (len(texts[k + 1]) + 1) // 2
        texts[k], texts[k + 1] = texts[k][:i] + texts[k + 1][j:], texts[k + 1][:j] + texts[k][i:]
        marks[k], marks[k + 1] = marks[k][:i] + marks[k + 1][j:], marks[k + 1][:j] + marks[k][i:]
    label = np.concatenate([np.array(m, dtype=np.int64) for m in marks])
    words = Words(np.frombuffer(b"\n".join([b" ".join(t) for t in texts]) + b"\n", dtype=np.uint8))
    lexicon = _lexicon(words, label, len(labels))
    _, rows, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    index, first = words.features(rows, lexicon)
    length = np.array([len(t) for t in texts])
    sequence = np.repeat(np.arange(len(texts)), length)
    step = np.arange(len(sequence)) - np.repeat(np.cumsum(length) - length, length)
    target = np.eye(len(labels), dtype=np.float32)[label]
    gold = np.zeros((len(labels), len(labels)))
    same = sequence[1:] == sequence[:-1]
    np.add.at(gold, (label[:-1][same], label[1:][same]), 1)
    opening = target[step == 0].sum(axis=0)
    by_word = np.argsort(inverse, kind="stable")
    word_first = np.searchsorted(inverse[by_word], np.arange(len(rows)))
    per_word = np.diff(np.append(first, len(index)))
    params = [np.zeros((1 << BITS, len(labels)), dtype=np.float32), np.zeros_like(gold), np.zeros(len(labels))]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in params]
    for t in range(1, steps + 1):
        emission = np.add.reduceat(params[0][index], first, axis=0)[inverse]
        padded = np.zeros((len(texts), STRETCH, len(labels)), dtype=np.float32)
        padded[sequence, step] = emission
        posterior, pairs, _ = forward_backward(padded, length, params[1], params[2])
        error = posterior[sequence, step] - target
        of_word = np.repeat(np.add.reduceat(error[by_word], word_first, axis=0), per_word, axis=0)
        grads = [np.stack([np.bincount(index, of_word[:, k], minlength=1 << BITS) for k in range(len(labels))], axis=1),
                 pairs - gold, posterior[:, 0].sum(axis=0) - opening]
        for k, g in enumerate(grads):
            g = (g + l2 * params[k]) / len(label)
            moments[k] = [0.9 * moments[k][0] + 0.1 * g, 0.99 * moments[k][1] + 0.01 * g * g]
            m, v = moments[k][0] / (1 - 0.9 ** t), moments[k][1] / (1 - 0.99 ** t)
            params[k] = params[k] - 0.1 * m / (np.sqrt(v) + 1e-8)
    return Model(labels, params[0].astype(np.float32), params[1].astype(np.float32), params[2].astype(np.float32), lexicon)


_STRETCHES = pa.schema([("lang", pa.string()), ("text", pa.binary())])


def train(docs: DataFrame) -> Model | None:
    """Learn from ``docs(text, lang)``: whole documents drawn by a hash of their text, and of
    all their stretches some drawn the same way. None where no text has a language."""
    rows = fixed(docs, lang=F.col("lang").cast("string"), text=F.lower(F.col("text").cast("string")))
    rows = rows.filter("lang is not null and text is not null")
    rows = rows.withColumn("draw", F.xxhash64("text", "lang"))
    drawn = rows.select("lang", "draw").distinct().orderBy("draw", "lang").limit(SAMPLE_DOCUMENTS)
    # the largest draw that belongs to the sample: one number
    bound = drawn.agg(F.max("draw")).first()[0]
    if bound is None:
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "text", 2 << 20):
            langs, texts = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.split()
                for at in range(0, len(words), STRETCH):
                    texts.append(b" ".join(words[at: at + STRETCH]))
                    langs.append(lang)
            yield record(_STRETCHES, langs, texts)

    some = rows.filter(F.col("draw") <= bound).dropDuplicates(["draw", "lang"])   # copies of a text are drawn once
    some = some.select("lang", F.col("text").cast("binary").alias("text"))
    stretches = some.mapInArrow(cut, "lang string, text binary").filter(F.octet_length("text") > 0)
    drawn = stretches.orderBy(F.xxhash64("text", "lang"), "text", "lang").limit(SAMPLE_STRETCHES)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [pair for b in batches for pair in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True)]
        if got:
            yield record(pa.schema([("model", pa.binary())]), [pickle.dumps(fit(got))])

    # the bounded sample is one partition; a task learns from it, the driver gets the model
    models = drawn.mapInArrow(learn, "model binary").collect()
    return pickle.loads(models[0].model) if models else None


_RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs(doc_id, text)`` by its whole text:
    the language with the largest share of its words' posteriors, and that share. Null
    texts and texts without a letter are ``und`` with score 0."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in some_rows(batches, "text", 4 << 20):
            letters = np.array(batch.column("letters").to_pylist(), dtype=bool)
            if model is None:
                yield record(_RESULT, batch.column("doc_id"), [UNKNOWN] * len(letters), np.zeros(len(letters)))
                continue
            sums = model.sums(batch.column("text").to_pylist())
            total = sums.sum(axis=1)
            best = sums.argmax(axis=1)
            known = letters & (total > 0)
            share_ = np.where(known, sums[np.arange(len(best)), best] / np.where(total > 0, total, 1), 0.0)
            yield record(_RESULT, batch.column("doc_id"), [model.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
                         np.clip(share_, 0, 1))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = fixed(docs, doc_id=F.col("doc_id").cast("long"), text=F.lower(text).cast("binary"), letters=text.rlike(r"\p{L}"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_of_documents(docs: DataFrame, learn_from) -> DataFrame:
    """Learn from the rows where ``learn_from`` holds, predict every row."""
    return predict(docs, train(docs.filter(learn_from)))
