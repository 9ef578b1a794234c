"""WARC archives of pages and their globally ordered capture index.

Writing: each task writes its pages as gzipped WARC records to archive files of
bounded size and returns, per archive, the index entries of its records sorted by
(URL key, time stamp, page). Such a locally sorted list is a run. Runs are range-
partitioned by the same order, which also splits the history of one hot URL, and each
range merges its pieces of all runs with a loser tree, so ranges in turn give
capture histories in global order.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once, with the largest
page_id; the others become revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsilt.llm.common import new_folder, record, share, some_rows, stored

MIN_REVISIT = 1000          # bytes of a payload that is worth a revisit record
ARCHIVE_BYTES = 64 << 20    # an archive is closed beyond so many
RANGE_ROWS = 100_000        # index entries one task merges
LEAST_RANGES = 32
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; works on every executor."""
    if not re.match(r"[a-z][a-z0-9+.-]+:", folder):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: pages of a site sort together."""
    try:
        parts = urlsplit(url.strip())
        host = ",".join(reversed((parts.hostname or "").split(".")))
        return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        return url.strip().lower()


def warc_record(page_id: int | None, url: str, stamp: str, payload: bytes, digest: bytes, original: int | None) -> bytes:
    """One record, gzipped. ``original``: the page that a revisit refers to."""
    http = _HTTP % len(payload)
    block = http if original is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Date: {stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        *([] if original is None else [f"WARC-Refers-To: <urn:x-page:{original}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    packer = zlib.compressobj(3, wbits=31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzipped record."""
    def headers(lines: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])
    head, rest = zlib.decompress(raw, 31).split(b"\r\n\r\n", 1)
    warc = headers(head)
    http, payload = rest[: int(warc["Content-Length"])].split(b"\r\n\r\n", 1)
    return warc, headers(http), payload


def _page(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


_ENTRY = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()),
                    ("start", pa.int64()), ("length", pa.int64())])
ENTRY = "run string, url_key string, stamp string, page_id long, start long, length long"
_order = lambda e: (e[1], e[2], e[3] is None, e[3] or 0, e[0], e[4])


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        out, entries, at, name = None, [], 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            entries.sort(key=_order)
            return record(_ENTRY, *map(list, zip(*entries, strict=True)))

        for batch in some_rows(batches, "html"):
            for page, url, stamp, html, digest, original in zip(*[batch.column(c).to_pylist() for c in (
                    "page_id", "url", "stamp", "html", "digest", "original")], strict=True):
                if out is None:
                    system.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"   # a repeated task writes archives of its own
                    out, entries, at = system.open_output_stream(f"{path}/{name}", compression=None), [], 0
                raw = warc_record(page, url, stamp, html, bytes.fromhex(digest), original)
                out.write(raw)
                entries.append((name, url_key(url), stamp, page, at, len(raw)))
                at += len(raw)
                if at >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()
    return run


class LoserTree:
    """Merge sorted iterables: each inner node holds the loser of its two sides, so the
    next item costs one comparison per level of the path that the last winner came by."""

    def __init__(self, runs: Iterable[Iterable], key):
        self.key, self.sources = key, [iter(r) for r in runs]
        self.items = [next(s, None) for s in self.sources]
        self.keys = [None if i is None else key(i) for i in self.items]
        n = len(self.sources)
        self.losers = [0] * max(1, n)
        winner = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.top = winner[1] if n > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def __iter__(self):
        n = len(self.sources)
        while n and self.keys[self.top] is not None:
            at = self.top
            yield self.items[at]
            self.items[at] = next(self.sources[at], None)
            self.keys[at] = None if self.items[at] is None else self.key(self.items[at])
            node = (at + n) // 2
            while node:
                if self._before(self.losers[node], at):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.top = at


_MERGED = pa.schema([*_ENTRY, ("place", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the pieces of runs that lie in one range. A shuffle keeps a run's order within
    a piece or not, so each piece is put right first, which costs nothing if it is."""
    runs: dict[str, list] = {}
    for batch in batches:
        for entry in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            runs.setdefault(entry[0], []).append(entry)
    for piece in runs.values():
        piece.sort(key=_order)
    out: list[tuple] = []
    for place, entry in enumerate(LoserTree([runs[r] for r in sorted(runs)], _order)):
        out.append((*entry, place))
        if len(out) == 10_000:
            yield record(_MERGED, *map(list, zip(*out, strict=True)))
            out = []
    if out:
        yield record(_MERGED, *map(list, zip(*out, strict=True)))


def write_archives(pages: DataFrame, captured_at: Column, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives into ``folder``; returns the runs.

    Null html and url are empty. Rows with the largest page_id of equal payloads are all
    responses, if it is repeated; a null page_id never is the largest. A null
    ``captured_at`` counts as the epoch.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.date_format(F.coalesce(captured_at, F.timestamp_seconds(F.lit(0))), "yyyyMMddHHmmss").alias("stamp"),
                        html.alias("html"), F.sha1(html).alias("digest"))
    large = F.octet_length("html") >= min_revisit
    copies = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1")
    original = F.when(large & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    marked = rows.join(copies.withColumnRenamed("digest", "_of"), F.col("digest") == F.col("_of"), "left").select(
        "page_id", "url", "stamp", "html", "digest", original.alias("original"))
    return stored(marked.mapInArrow(_write(folder), ENTRY), "warc-runs")


def capture_history(runs: DataFrame) -> DataFrame:
    """All entries in global order of (URL key, time stamp, page_id): ``range`` and the
    ``place`` in it count up along it."""
    ranges = share(runs.count(), RANGE_ROWS, LEAST_RANGES)
    order = ["url_key", "stamp", F.col("page_id").asc_nulls_last(), "run", "start"]
    merged = runs.repartitionByRange(ranges, *order).mapInArrow(_merge, ENTRY + ", place long")
    return merged.withColumn("range", F.spark_partition_id())


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(history: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, payload`` of each
    entry, from its record. A response's digest is computed from its payload and must
    equal its header's; a revisit has both figures of the full payload in its headers.
    payload: null for revisits and unless asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        opened = lru_cache(maxsize=64)(lambda name: system.open_input_file(f"{path}/{name}"))
        for batch in batches:
            rows = []
            for name, start, length in zip(*[batch.column(c).to_pylist() for c in ("run", "start", "length")], strict=True):
                warc, http, payload = parse_record(opened(name).read_at(length, start))
                digest = base64.b32decode(warc["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                whole = warc["WARC-Type"] == "response"
                if whole and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{name} at {start}: the payload does not have its digest")
                rows.append((_page(warc["WARC-Record-ID"]), int(http["Content-Length"]), digest, warc["WARC-Type"],
                             _page(warc.get("WARC-Refers-To")), payload if whole and payloads else None))
            if rows:
                yield record(_READ, *map(list, zip(*rows, strict=True)))

    return history.select("run", "start", "length").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, captured_at: Column, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write the archives and their ordered index; returns the index and the folder."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return capture_history(write_archives(pages, captured_at, folder)), folder
