"""A bit table of fixed size over a set of 64-bit hashes: it lets through every member
and few others, whatever the size of the set, so broadcasting it is always safe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netsilt.llm.common import record, some_rows

BITS = 27                 # 2 ** 27 bits: 16 MB
_BLOCK = 20
_U = np.uint64


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    mask = _U((1 << bits) - 1)
    return np.stack([hashes & mask, (hashes >> _U(64 - bits)) & mask]).astype(np.int64)


def bit_table(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bit table of ``hashes``' one long column; blocks are made in tasks and the
    driver receives 2 ** bits bits."""
    block = min(_BLOCK, bits)
    packed = pa.schema([("block", pa.int32()), ("places", pa.binary())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy().view(_U), bits))
            cuts = np.searchsorted(at >> block, np.arange((1 << bits - block) + 1))
            full = np.flatnonzero(np.diff(cuts))
            low = (at & ((1 << block) - 1)).astype(np.uint32)
            yield record(packed, full.astype(np.int32), [low[cuts[k]: cuts[k + 1]].tobytes() for k in full])

    def fill(table: pa.Table) -> pa.Table:
        bit = np.zeros(1 << block, dtype=bool)
        for places in table.column("places").to_pylist():
            bit[np.frombuffer(places, dtype=np.uint32)] = True
        return pa.table([table.column("block")[:1], pa.array([np.packbits(bit, bitorder="little").tobytes()], pa.binary())],
                        schema=packed)

    out = np.zeros(1 << bits - 3, dtype=np.uint8)
    rows = hashes.mapInArrow(spread, "block int, places binary").groupBy("block").applyInArrow(
        fill, "block int, places binary")
    for row in rows.toLocalIterator():
        part = np.frombuffer(row.places, dtype=np.uint8)
        out[row.block * len(part): (row.block + 1) * len(part)] = part
    return out


COUNTERS = 20             # 2 ** 20 counters of 32 bits: 4 MB


def counter_table(hashes: DataFrame, bits: int = COUNTERS) -> np.ndarray:
    """How many of ``hashes``' one column of packed 64-bit arrays fall on each of 2 ** bits places: never less than
    how often a hash occurs. Blocks are summed in tasks and the driver receives the table, whose size is fixed."""
    block = min(_BLOCK - 4, bits)
    packed = pa.schema([("block", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, batch_column, 4 << 20):
            h = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=_U)
            at, n = np.unique((h & _U((1 << bits) - 1)).astype(np.int64), return_counts=True)
            cuts = np.searchsorted(at >> block, np.arange((1 << bits - block) + 1))
            full = np.flatnonzero(np.diff(cuts))
            low = (at & ((1 << block) - 1)).astype(np.uint32)
            yield record(packed, full.astype(np.int32), [low[cuts[k]: cuts[k + 1]].tobytes() for k in full],
                         [n[cuts[k]: cuts[k + 1]].astype(np.uint32).tobytes() for k in full])

    def fill(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << block, dtype=np.int64)
        for places, counts in zip(table.column("places").to_pylist(), table.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(places, dtype=np.uint32)] += np.frombuffer(counts, dtype=np.uint32)
        low = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
        return pa.table([table.column("block")[:1], pa.array([low.tobytes()], pa.binary()), pa.array([b""], pa.binary())], schema=packed)

    batch_column = hashes.columns[0]
    out = np.zeros(1 << bits, dtype=np.uint32)
    rows = hashes.mapInArrow(spread, "block int, places binary, counts binary").groupBy("block").applyInArrow(
        fill, "block int, places binary, counts binary")
    for row in rows.toLocalIterator():
        part = np.frombuffer(row.places, dtype=np.uint32)
        out[row.block * len(part): (row.block + 1) * len(part)] = part
    return out


def maybe_in(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be a member; members always are."""
    bits = (len(table) * 8).bit_length() - 1
    one, two = _places(hashes, bits)
    out = (table[one >> 3] >> (one & 7).astype(np.uint8)) & 1 == 1
    some = np.flatnonzero(out)
    two = two[some]
    out[some] = (table[two >> 3] >> (two & 7).astype(np.uint8)) & 1 == 1
    return out
