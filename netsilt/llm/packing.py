"""Packing of tokenised examples into sequences: vector bin packing by dot products.

An example asks for tokens, one segment and loss-bearing tokens at once; a sequence
has a capacity in each. An open sequence repeatedly takes the example whose demand
has the largest weighted dot product with what is left of its capacity, among those
that fit, until none does; demands count relative to capacity, and a resource that
is asked for more on average weighs more.

Examples longer than a sequence are first cut into full sequences and a rest. The
rests are dealt at random into blocks of bounded size that are packed side by
side. Within a block equal demands are interchangeable, so a step looks at the
distinct demands only. Where cutting is allowed, an example that almost fits is cut
to fill the sequence, and a block's last sequence is cut at powers of two: what is
left open is padding only if segments or loss tokens ran out first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsilt.llm.common import as_bytes, fixed, pieces, record, share, some_rows, stored

MAX_TOKENS = 2048
MAX_SEGMENTS = 512
BLOCK_PIECES = 4096         # rests one task packs together
CACHE_WORDS = 300_000       # encoded words in each of a worker's two generations
SLACK_CUT = 64              # a gap of this many tokens or more is filled by cutting an example

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("loss", pa.int64()),
                     ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, loss long, doc_tokens long, ids binary"


def _letters_of_bytes() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand
    for themselves, the others for the letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder(dict):
    """Bytes of a lower-cased word -> its ids as little-endian 32-bit bytes.

    The vocabulary lower-cases, drops white space and never joins over it, nor between
    a letter and punctuation, so a text's ids are those of its words in a row, and a
    word's those of its stem and of the punctuation that ends it. A stem of letters
    goes straight to the merges; anything odd goes through the whole tokenizer. Words
    met lately are kept in two generations.
    """

    PUNCTUATION = b".,;:!?|*#&%$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _letters_of_bytes()
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        out = self.old.get(word)
        if out is None:
            stem = word.rstrip(self.PUNCTUATION)
            if len(stem) < len(word) and stem[-1:].isalpha():
                out = self[stem] + self[word[len(stem):]]
            else:
                out = np.array(self._encode(word), dtype="<u4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = out
        return out

    def _encode(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        # letters below U+0250 that are lower-cased and composed already: one token to merge
        if text.isalpha() and max(text) < "\u0250" and text.lower() == text:
            return [t.id for t in self.merge("".join([self.letters[b] for b in word]))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: bytes) -> bytes:
        if b"<|" in text:   # may hold a special token, which is not lower-cased
            return b"".join([np.array(self.tokenizer.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")
                             .tobytes() for part in pieces(text)])
        return b"".join([b"".join(map(self.__getitem__, part.lower().split())) for part in pieces(text)])


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder: its tasks share what earlier ones have encoded."""
    return Encoder(path)


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = MAX_TOKENS,
              sum_full: bool = False) -> DataFrame:
    """Full pieces of ``max_tokens`` and one rest per document, all tokens loss-bearing.
    ``ids`` of a rest stay with it, since it may be cut again; with ``sum_full`` a full
    piece keeps only its big-endian checksum there (4 bytes)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in some_rows(batches, "text", 2 << 20):
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                n = len(ids) // 4
                for start in range(0, n, max_tokens):
                    part = ids[4 * start: 4 * (start + max_tokens)]
                    size = len(part) // 4
                    if sum_full and size == max_tokens:
                        part = zlib.crc32(part).to_bytes(4, "big")
                    for column, value in zip(rows, (doc, start, size, n, part), strict=True):
                        column.append(value)
            yield record(_PIECES, rows[0], rows[1], rows[2], rows[2], rows[3], rows[4])

    return fixed(docs, doc_id=F.col("doc_id").cast("long"), text=as_bytes("text")).mapInArrow(run, PIECES)


def pack_block(tokens: np.ndarray, loss: np.ndarray, caps: tuple[int, int, int], cut: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences of one block as lists of (example, first token, tokens). An example
    cut for its tokens gives up loss tokens in proportion, rounded up."""
    cap = np.array(caps, dtype=float)
    demand = np.stack([tokens, np.ones_like(tokens), np.minimum(loss, tokens)], axis=1)
    if len(demand) and not (demand <= cap).all() and not cut:
        raise ValueError("an example exceeds a sequence's capacity and may not be cut")
    kinds, kind = np.unique(demand, axis=0, return_inverse=True)
    kind = kind.ravel()
    members: list[list[tuple[int, int]]] = [[] for _ in kinds]   # (example, first token)
    for i in np.argsort(-tokens, kind="stable"):
        members[kind[i]].append((int(i), 0))
    known = {tuple(k): i for i, k in enumerate(kinds.tolist())}
    kinds = kinds.astype(float)
    left = np.array([len(m) for m in members])
    mean = demand.mean(axis=0) / cap if len(demand) else np.ones(3)
    scaled = kinds / cap * mean / cap     # weight * demand, per unit of remaining capacity
    out: list[list[tuple[int, int, int]]] = []

    def put_back(item: tuple[int, int], row: tuple[int, int, int]) -> None:
        nonlocal kinds, scaled, left
        if row not in known:
            known[row] = len(kinds)
            kinds = np.vstack([kinds, np.array(row, dtype=float)])
            scaled = kinds / cap * mean / cap
            left = np.append(left, 0)
            members.append([])
        members[known[row]].append(item)
        left[known[row]] += 1

    while left.any():
        free, sequence = cap.copy(), []
        while True:
            fits = (left > 0) & (kinds <= free).all(axis=1)
            if fits.any():
                best = int(np.argmax(np.where(fits, scaled @ free, -1.0)))
                i, first = members[best].pop()
                left[best] -= 1
                sequence.append((i, first, int(kinds[best][0])))
                free -= kinds[best]
                continue
            gap = int(free[0])
            if not cut or gap < 1 or free[1] < 1 or free[2] < 1 or not left.any() or (sequence and gap < SLACK_CUT):
                break
            # cut the largest example left so that it fills the gap
            best = int(np.argmax(np.where(left > 0, kinds[:, 0], -1.0)))
            size, bears = int(kinds[best][0]), int(kinds[best][2])
            take = min(gap, size, int(free[2] * size // bears) if bears else gap)
            if take < 1:
                break
            used = -(-bears * take // size)
            i, first = members[best].pop()
            left[best] -= 1
            sequence.append((i, first, take))
            free -= (take, 1, used)
            if size > take:
                put_back((i, first + take), (size - take, 1, bears - min(bears, used)))
        out.append(sequence)
    return out


def at_powers_of_two(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut a sequence into ones whose lengths are powers of two: no padding remains."""
    total, out = sum(n for *_, n in sequence), []
    todo = list(reversed(sequence))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            i, first, n = todo.pop()
            take = min(n, room)
            part.append((i, first, take))
            room -= take
            if n > take:
                todo.append((i, first + take, n - take))
        out.append(part)
    return out


_PLACED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place(max_tokens: int, max_segments: int, max_loss: int, cut: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("piece", "ascending")])
        block = table.column("block")[0].as_py()
        get = lambda name: table.column(name).to_pylist()
        docs, starts, sizes, loss, totals, ids = map(get, ("doc_id", "start", "length", "loss", "doc_tokens", "ids"))
        sequences = pack_block(np.array(sizes), np.array(loss), (max_tokens, max_segments, max_loss), cut)
        if cut and sequences:
            sequences = [s for full in sequences
                         for s in ([full] if max_tokens - sum(n for *_, n in full) < SLACK_CUT else at_powers_of_two(full))]
        rows: list[list] = [[] for _ in _PLACED]
        for k, sequence in enumerate(sequences):
            offset = 0
            for i, first, n in sequence:
                part = ids[i][4 * first: 4 * (first + n)]
                for column, value in zip(rows, (docs[i], starts[i] + first, n, zlib.crc32(part), totals[i],
                                                (block << 32) | k, offset), strict=True):
                    column.append(value)
                offset += n
        return pa.table(dict(zip(_PLACED.names, rows, strict=True)), schema=_PLACED)
    return run


def pack(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
         max_loss: int | None = None, cut: bool = True, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Place ``examples`` (the columns of ``PIECES``) into sequences: ``doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset``.

    A sequence holds at most ``max_tokens`` tokens, ``max_segments`` examples and
    ``max_loss`` loss-bearing tokens (default: all may bear loss). With ``cut`` false
    examples stay whole, and one beyond a limit is an error. Repeated rows are placed
    each; equal examples may be swapped; an empty table gives an empty result.
    """
    rests = stored(examples, "pieces")
    full = (F.col("length") == max_tokens) & (F.octet_length("ids") == 4) & F.lit(max_tokens > 1)
    numbered = rests.withColumn("piece", F.monotonically_increasing_id())  # over written files: stable
    whole = numbered.filter(full).select(
        "doc_id", "start", "length",
        F.conv(F.hex("ids"), 16, 10).cast("long").alias("ids_crc32"), "doc_tokens",
        (F.lit(1 << 62) + F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = numbered.filter(~full)
    blocks = share(open_.count(), block_pieces, 16)
    dealt = open_.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(blocks)))
    placed = dealt.groupBy("block").applyInArrow(
        _place(max_tokens, max_segments, max_tokens if max_loss is None else max_loss, cut),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.unionByName(whole)


def packed_documents(docs: DataFrame, tokenizer_path: str, **limits) -> DataFrame:
    """Tokenise and pack ``docs(doc_id, text)``. Null text is empty and has the end id
    alone; repeated rows are packed each; other columns are ignored."""
    tokens = limits.get("max_tokens", MAX_TOKENS)
    whole = limits.get("max_loss") is None
    return pack(tokenised(docs, tokenizer_path, max_tokens=tokens, sum_full=whole), **limits)
