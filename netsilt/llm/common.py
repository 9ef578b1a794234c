"""Helpers shared by the operators: stored intermediate tables, words, word hashes."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsilt.session import shared_folder

#: The white space that separates words.
WHITE_SPACE = b" \t\n\x0b\x0c\r"

PIECE_BYTES = 1 << 20          # text that is turned into arrays at once
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITE_SPACE)] = True
_PRIME = 0x9E3779B97F4A7C15    # odd, so that it has an inverse modulo 2**64
_U = np.uint64


# ------------------------------------------------------------------ tables

def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write once to the shared folder and go on from the files, so that what reads
    it twice, or again after an executor was lost, sees the same rows."""
    folder = new_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(folder) if partition_by else df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def share(value: float, each: float, least: int = 1) -> int:
    """How many parts of about ``each`` hold ``value``."""
    return max(least, math.ceil(value / each))


def crc_mod(column: str | Column, n: int) -> Column:
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n


def as_bytes(column: str) -> Column:
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the named columns, so that other columns never clash with working ones."""
    return df.select(*[c.alias(name) for name, c in columns.items()])


def whole_row(df: DataFrame, *without: str) -> Column:
    """All columns of ``df`` but some as one struct, never an empty one: in it the user's names meet no working ones."""
    names = [c for c in df.columns if c not in without]
    spare = "_"
    while spare in df.columns:
        spare += "_"
    return F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias(spare))


def unpacked(df: DataFrame, row: str = "row") -> list[Column]:
    """The user's columns again."""
    return [F.col(f"{row}.`{f.name}`").alias(f.name) for f in df.schema[row].dataType.fields[:-1]]


# ------------------------------------------------------------------- words

def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit integers (splitmix64)."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence whose beginning hashes to ``left`` and goes on with ``right``."""
    return mix(left * _U(0xC2B2AE3D27D4EB4F) + right + _U(0x165667B19E3779F9))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _PRIME, dtype=_U)
    down = np.full(n + 1, pow(_PRIME, -1, 1 << 64), dtype=_U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def spans(buf: np.ndarray, apart: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word. apart: which byte values separate words."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~apart[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: differences of one running polynomial sum."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    size = max(PIECE_BYTES, 1 << max(0, len(buf) - 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """Cut a text at white space into pieces of about ``size``; nothing is left out."""
    at, n = 0, len(text)
    while at < n:
        to = min(n, at + size)
        while to < n and text[to] not in WHITE_SPACE:
            to += 1
        yield text[at:to]
        at = to


def _hashes(text: bytes) -> np.ndarray:
    buf = np.frombuffer(text, dtype=np.uint8)
    return span_hashes(buf, *spans(buf))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The word hashes of each text. Short texts are hashed together."""
    out: list[np.ndarray] = [np.zeros(0, dtype=_U)] * len(texts)

    def flush(group: list[int]) -> None:
        lengths = np.array([len(texts[i]) + 1 for i in group])
        buf = np.frombuffer(b"\n".join([texts[i] for i in group]) + b"\n", dtype=np.uint8)
        starts, ends = spans(buf)
        h = span_hashes(buf, starts, ends)
        cuts = np.searchsorted(starts, np.cumsum(lengths)[:-1])
        for i, part in zip(group, np.split(h, cuts), strict=True):
            out[i] = part

    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text) > PIECE_BYTES:
            out[i] = np.concatenate([_hashes(p) for p in pieces(text)] or [out[i]])
            continue
        if size + len(text) > PIECE_BYTES and group:
            flush(group)
            group, size = [], 0
        group.append(i)
        size += len(text) + 1
    if group:
        flush(group)
    return out


# ------------------------------------------------------------------- arrow

def some_rows(batches: Iterator[pa.RecordBatch], column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes in ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths.astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


def lower_ascii(text: bytes) -> bytes:
    """Lower-cases A-Z only, as ``bytes.lower`` does."""
    return text.lower()
