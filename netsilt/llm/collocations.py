"""Phrases that stick together, mined from a weighted de Bruijn graph of words.

Words are counted once to know which are frequent and how they are spelt; a phrase that
is frequent has frequent words only. Then each position of a text sends one gram: the
longest one, ``max_words`` long, or what is left of it before the piece ends or a rare
word comes. Long grams are the edges of a de Bruijn graph whose nodes are their first and
last ``max_words - 1`` words; cut ones are the corrections for paths that end in a node. Counts of
shorter grams are never read from the text: what flows out of a node, along edges and into ends,
is how often the node's gram occurs, and nodes are the edges of the next smaller graph.

A task sorts its positions into a prefix tree of grams, sums the flows in it from the leaves
up, and sends each level packed per bucket by the gram's hash, so that a gram costs a
task one entry however frequent it is. Frequent edges are then compacted: nodes with one
edge in and one out join their edges to paths, by pointer doubling. Along a path a
node's edges are neighbours, which is what the test for phrases inside longer ones reads.

Words are 64-bit hashes of (language, word) until the end. Every hash of a frequent word is checked to
stand for one word; if not, everything is done again with another seed, so counts are exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsilt.llm.bloom import bit_table, maybe_in
from netsilt.llm.common import PIECE_BYTES, as_bytes, chain, fixed, mix, record, share, some_rows, span_hashes, spans, stored

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
INSIDE_PERCENT = 50          # a phrase goes if a longer one around it has such a share of its count
UNKNOWN = "und"
BUCKET_BYTES = 8 << 20       # of text per bucket of grams
LEAST_BUCKETS = 48
FLUSH_TOKENS = 500_000       # a task sorts so many positions at once
FLUSH_WORDS = 1_200_000      # a task merges the distinct words of so many
PATH_EDGES = 1000            # a compacted path is stored in rows of at most so many edges
#: The bytes that end a piece; those and blanks end a word.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
_U = np.uint64
_BITS = 24                   # more than the words a task sorts at once
_END = np.zeros(256, dtype=bool)
_END[list(ENDS)] = True
_APART = _END.copy()
_APART[list(BLANKS)] = True
_CUT = re.compile(b"[" + re.escape(ENDS + BLANKS) + b"]")


# ------------------------------------------------------------------- words

def _buffers(texts: list[bytes], size: int) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Lower-cased texts as buffers of about ``size`` bytes with the start and the text number of each part
    in it. Texts end in a line feed; long ones are cut where words end and go on in the next buffer."""
    parts, starts, rows, held = [], [], [], 0
    for row, text in enumerate(texts):
        at, text = 0, text.lower() + b"\n"
        while at < len(text):
            found = _CUT.search(text, at + size) if len(text) - at > size else None
            to = found.start() if found else len(text)
            parts.append(text[at:to])
            starts.append(held)
            rows.append(row)
            held += to - at
            at = to
            if held >= size:
                yield b"".join(parts), starts, rows
                parts, starts, rows, held = [], [], [], 0
    if parts:
        yield b"".join(parts), starts, rows


def language_key(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=8).digest(), "little")


def read_words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple]:
    """Per buffer: keys of its words, the number of each one's piece (never falling),
    the buffer, first and last byte of each word, its language's number, and the languages."""
    pieces = 0
    for batch in some_rows(batches, "text", 2 << 20):
        langs = batch.column("lang").dictionary_encode()
        names, of_row = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        salt = np.array([language_key(n, seed) for n in names], dtype=_U)
        for text, begins, rows in _buffers(batch.column("text").to_pylist(), PIECE_BYTES):
            buf = np.frombuffer(text, dtype=np.uint8)
            starts, ends = spans(buf, _APART)
            lang = of_row[np.array(rows)[np.searchsorted(begins, starts, side="right") - 1]]
            passed = np.cumsum(_END[buf])
            yield mix(span_hashes(buf, starts, ends) ^ salt[lang]), pieces + passed[starts], text, starts, ends, lang, names
            pieces += int(passed[-1])


_WORDS = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])
WORDS = "key long, lang string, word string, f long"


def _count_words(seed: int):
    """Distinct words with counts; per language the empty word stands for all its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            keys, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            langs, words = [x for h in held for x in h[2]], [x for h in held for x in h[3]]
            known, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            return record(_WORDS, known.view(np.int64), [langs[i] for i in first], [words[i] for i in first],
                          np.bincount(inverse, counts).astype(np.int64))

        size = 0
        for keys, _, text, starts, ends, lang, names in read_words(batches, seed):
            known, first, counts = np.unique(keys, return_index=True, return_counts=True)
            all_of = np.flatnonzero(per := np.bincount(lang, minlength=len(names)))
            totals = mix(np.array([language_key(names[k], seed) for k in all_of], dtype=_U))
            held.append((np.concatenate([known, totals]), np.concatenate([counts, per[all_of]]),
                         [names[lang[i]] for i in first] + [names[k] for k in all_of],
                         [text[starts[i]: ends[i]].decode() for i in first] + [""] * len(all_of)))
            size += len(keys)
            if size >= FLUSH_WORDS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
    return run


def vocabulary(texts: DataFrame, min_count: int) -> tuple[DataFrame, int]:
    """``key, lang, word, f`` of the words that occur ``min_count`` times or more in ``texts(text, lang)``, for the
    empty word all words of the language; and the seed with which no key among these stands for two words."""
    seed = 0
    while True:
        counted = texts.mapInArrow(_count_words(seed), WORDS).groupBy("key").agg(
            F.sum("f").alias("f"), F.min(F.struct("lang", "word")).alias("low"), F.max(F.struct("lang", "word")).alias("high"))
        found = stored(counted.filter((F.col("f") >= min_count) | (F.col("low.word") == "")), "vocabulary")
        if found.filter("low != high").isEmpty():
            return found.select("key", "low.lang", "low.word", "f"), seed
        seed += 1


# ------------------------------------------------------------------- grams

_SENT = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("size", pa.int32()), ("words", pa.binary()),
                   ("ids", pa.list_(pa.binary())), ("counts", pa.binary())])
SENT = "level int, bucket int, size int, words binary, ids array<binary>, counts binary"


def _small(a: np.ndarray) -> bytes:
    """The bytes of an array in the narrowest width that holds it."""
    return a.astype(np.min_scalar_type(int(a.max()))).tobytes()


def _large(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{len(blob) // size}").astype(np.int64)


def _packed(level: int, columns: list[np.ndarray], counts: np.ndarray, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket: its own word list, and per gram the places of its words in it."""
    h = keys[columns[0]]
    for c in columns[1:]:
        h = chain(h, keys[c])
    bucket = (mix(h) % _U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[b]: cuts[b + 1]]
        used, places = np.unique(np.concatenate([c[at] for c in columns]), return_inverse=True)
        ids = [_small(p) for p in np.split(places, len(columns))]
        rows.append((level, b, len(at), keys[used].tobytes(), ids, _small(counts[at])))
    return record(_SENT, *map(list, zip(*rows, strict=True)))


def gram_counts(ids: np.ndarray, joined: np.ndarray, starts: int, most: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """Of the positions before ``starts``: grams of 1 to ``most`` words, as columns of word numbers, with counts.

    ids: word numbers, 0 for rare ones. joined: whether a position and the next lie in one piece. One pass per
    length builds the prefix tree; only its leaves are counted, and counts flow to the shorter grams.
    """
    at = np.flatnonzero(ids[:starts])
    prefix, alive = ids[at] - 1, np.ones(len(at), dtype=bool)
    words = np.arange(1, int(ids.max(initial=0)) + 1)
    tree: list[tuple] = [(None, words)]
    for k in range(1, most):
        before = np.minimum(at + k - 1, len(joined) - 1)
        alive = alive & (at + k < len(ids))
        alive[alive] = joined[before[alive]]
        last = np.zeros(len(at), dtype=np.int64)
        last[alive] = ids[at[alive] + k]
        alive = last > 0
        known, prefix = np.unique(prefix << _BITS | last, return_inverse=True)
        tree.append((known >> _BITS, known & (1 << _BITS) - 1))
    counts = [np.bincount(prefix, minlength=len(tree[-1][1]))]
    for k in range(most - 1, 0, -1):      # what flows out of a node: its edges and its ends
        counts.insert(0, np.bincount(tree[k][0], counts[0], minlength=len(tree[k - 1][1])).astype(np.int64))
    out = []
    for k in range(most):
        rows = np.flatnonzero((tree[k][1] > 0) & (counts[k] > 0))
        columns, node = [], rows
        for j in range(k, -1, -1):
            columns.insert(0, tree[j][1][node])
            node = tree[j][0][node] if j else node
        out.append((columns, counts[k][rows]))
    return out


def _count_grams(bits: np.ndarray, buckets: int, most: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pieces = [np.zeros(0, dtype=_U)], [np.zeros(0, dtype=np.int64)]

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            key, piece = np.concatenate(keys), np.concatenate(pieces)
            starts = len(key) if last else max(0, len(key) - most + 1)   # later grams are not complete yet
            ids = np.zeros(len(key), dtype=np.int64)
            known = maybe_in(bits, key)
            names, ids[known] = np.unique(key[known], return_inverse=True)
            ids[known] += 1
            names = np.concatenate([np.zeros(1, dtype=_U), names])
            for level, (columns, counts) in enumerate(gram_counts(ids, piece[1:] == piece[:-1], starts, most), 1):
                if len(counts):
                    yield _packed(level, columns, counts, names, buckets)
            keys[:], pieces[:] = [key[starts:]], [piece[starts:]]

        size = 0
        for key, piece, *_ in read_words(batches, seed):
            keys.append(key)
            pieces.append(piece)
            size += len(key)
            if size >= FLUSH_TOKENS:
                yield from flush(False)
                size = 0
        yield from flush(True)
    return run


_GRAMS = pa.schema([("words", pa.list_(pa.int64())), ("f", pa.int64())])


def _sum_grams(min_count: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["size", "words", "ids", "counts"]).to_pylist()
        keys = [np.frombuffer(r["words"], dtype=_U) for r in rows]
        columns = [np.concatenate([k[_large(r["ids"][j], r["size"])] for k, r in zip(keys, rows, strict=True)])
                   for j in range(len(rows[0]["ids"]))]
        counts = np.concatenate([_large(r["counts"], r["size"]) for r in rows])
        order = np.lexsort(columns[::-1])
        fresh = np.zeros(len(order), dtype=bool)
        fresh[0] = True
        for c in columns:
            fresh[1:] |= c[order[1:]] != c[order[:-1]]
        first = np.flatnonzero(fresh)
        f = np.add.reduceat(counts[order], first)
        often = f >= min_count
        words = np.stack([c[order[first[often]]] for c in columns], axis=1).view(np.int64)
        offsets = np.arange(len(words) + 1, dtype=np.int32) * len(columns)
        return pa.table([pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.ravel())), pa.array(f[often])], schema=_GRAMS)
    return run


def frequent_grams(texts: DataFrame, vocabulary: DataFrame, seed: int, most: int, min_count: int) -> DataFrame:
    """``words, f`` of the grams of 1 to ``most`` words in ``texts(text, lang)`` that occur ``min_count`` times or more."""
    bits = bit_table(vocabulary.filter("word != ''").select("key"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = share(size, BUCKET_BYTES, LEAST_BUCKETS)
    sent = texts.mapInArrow(_count_grams(bits, buckets, most, seed), SENT)
    return stored(sent.groupBy("level", "bucket").applyInArrow(_sum_grams(min_count), "words array<long>, f long"), "grams")


# ------------------------------------------------------------------- graph

def compact(edges: DataFrame) -> DataFrame:
    """``words, weights`` of the paths of ``edges(words, f)``, grams of one length n: a path of k edges has
    n + k - 1 words and k weights. Two edges are joined if no other enters or leaves the node between them.
    Edges of a circle without a branch stay alone, and a path is cut after ``PATH_EDGES`` edges."""
    n = F.size("words")
    tail, head = F.slice("words", F.lit(1), n - 1), F.slice("words", F.lit(2), n - 1)
    alone = lambda node, name: edges.groupBy(node.alias(f"{name}_node")).agg(
        F.count("*").alias("k"), F.max("words").alias(name)).filter("k = 1").drop("k")
    links = alone(head, "up").join(alone(tail, "edge"), F.col("up_node") == F.col("edge_node")).filter("up != edge").select("edge", "up")
    state = stored(edges.select(F.col("words").alias("own"), "f").join(links, F.col("own") == F.col("edge"), "left").select(
        "own", "f", F.coalesce("up", "own").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("far")), "links")
    left = None
    while True:
        ahead = state.select(F.col("own").alias("at"), F.col("up").alias("next"), F.col("far").alias("more"))
        going = F.col("more") > 0
        state = stored(state.join(ahead, F.col("up") == F.col("at")).select(
            "own", "f", F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"), going.alias("going")), "links")
        now = state.filter("going").count()
        if now == 0 or now == left:     # of a chain, some edge reaches its head in every round; circles never do
            break
        left = now
    state = state.select("own", "f", F.when(F.col("going"), F.col("own")).otherwise(F.col("up")).alias("up"),
                         F.when(F.col("going"), 0).otherwise(F.col("far")).alias("far"))
    rows = state.groupBy("up", F.floor(F.col("far") / PATH_EDGES).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("far", "own", "f"))).alias("edges"))
    begin = F.col("edges")[0]["own"]
    rest = F.transform(F.slice("edges", F.lit(2), F.size("edges")), lambda e: F.element_at(e["own"], -1))
    return rows.select(F.concat(begin, rest).alias("words"), F.transform("edges", lambda e: e["f"]).alias("weights"))


def _edges_of(paths: DataFrame, n: int) -> DataFrame:
    return paths.select("words", F.posexplode("weights").alias("i", "a")).select(
        F.slice("words", F.col("i") + 1, F.lit(n)).alias("words"), "a")


def _heaviest_edge(paths: DataFrame, n: int) -> DataFrame:
    """``inner, around``: per node of the paths the weight of its heaviest edge; within a path its edges are neighbours."""
    both = F.transform(F.sequence(F.lit(0), F.size("weights")), lambda i: F.struct(
        F.slice("words", i + 1, F.lit(n - 1)).alias("node"),
        F.greatest(F.get("weights", i - 1), F.get("weights", i)).alias("weight")))
    return paths.select(F.explode(both).alias("x")).groupBy(F.col("x.node").alias("inner")).agg(F.max("x.weight").alias("around"))


def _candidates(grams: DataFrame, most: int) -> DataFrame:
    """``words, a, around``: grams of 2 or more words with the count of the most frequent one around them that is
    a word longer. A frequent phrase around a gram holds one that is a word longer and no rarer, so this decides."""
    paths = stored(compact(grams.filter(F.size("words") == most)), "paths")
    found = _edges_of(paths, most).withColumn("around", F.lit(None).cast("long"))
    around = _heaviest_edge(paths, most)
    for n in range(most - 1, 1, -1):
        shorter = grams.filter(F.size("words") == n)
        found = found.unionByName(shorter.join(around, F.col("words") == F.col("inner"), "left").select("words", F.col("f").alias("a"), "around"))
        ends = F.explode(F.array(F.slice("words", 1, n - 1), F.slice("words", 2, n - 1)))
        around = shorter.select(ends.alias("inner"), "f").groupBy("inner").agg(F.max("f").alias("around"))
    return found


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP,
                 inside: int = INSIDE_PERCENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: per language the ``top`` phrases of 2 to ``max_words`` words.

    a: count of the phrase, at least ``min_count``; l, r: counts of its two parts at the weakest cut; n: words of the
    language; score: floor(1000000 a a / (l r)). ``docs(text, lang)``: null texts are empty, a null lang is ``und``. Phrases
    inside a longer frequent one with at least ``inside`` percent of their count are left out. Ties go to the more
    frequent phrase, then to the smaller in byte order. Repeated rows count each; other columns are not read;
    texts of any length are read in pieces; an empty table has no rows. Counts up to 10 ** 13 - 1 are exact.
    """
    if max_words < 2:
        raise ValueError("a phrase has at least 2 words")
    texts = fixed(docs, text=as_bytes("text"), lang=F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)))
    words, seed = vocabulary(texts, min_count)
    grams = frequent_grams(texts, words, seed, max_words, min_count)
    found = _candidates(grams, max_words).filter(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * inside))
    found = stored(found.select("words", "a"), "phrases")
    cut = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
        F.slice("words", F.lit(1), k).alias("first"), F.slice("words", k + 1, F.size("words")).alias("second"))))
    parts = found.select("words", "a", cut.alias("k", "cut"))
    of = lambda name: grams.select(F.col("words").alias(f"{name}_words"), F.col("f").alias(name))
    scored = parts.join(of("l"), F.col("cut.first") == F.col("l_words")).join(of("r"), F.col("cut.second") == F.col("r_words"))
    score = F.expr("(cast(a as decimal(13,0)) * cast(a as decimal(13,0)) * cast(1000000 as decimal(7,0)))"
                   " div (cast(l as decimal(13,0)) * cast(r as decimal(13,0)))")
    scored = scored.select("words", "a", "k", "l", "r", score.alias("score"))
    weakest = scored.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelt = weakest.select("words", "a", "cut", F.posexplode("words").alias("at", "key")).join(
        words.select(F.col("key").alias("known"), "lang", "word"), F.col("key") == F.col("known"))
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ")
    named = spelt.groupBy("words", "a", "cut").agg(F.min("lang").alias("lang"), phrase.alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    best = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    total = words.filter("word = ''").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    return best.join(total, F.col("lang") == F.col("of")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"))

