"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``RADIUS`` = 3 bits meet in a value at most one bit from
the one and two bits from the other. Every fingerprint emits the values of its
half balls, the values are shuffled, and those that meet are linked.

Whole balls of radius two (2,081 values) are not needed. Split fingerprints by the
parity of their set bits: a distance of 1 or 3 lies between an even and an odd
one, a distance of 2 within a parity. All emit the 64 values one bit away, odd
ones also themselves and the values two bits away whose bits lie in one half of
the word: of three differing bits two share a half; the even one supplies the third.
That makes 64 or 1,057 values. Values carry their own parity, so the lists meet as
they should: at an odd value even ones at distance 1 meet odd ones at distance 0
or 2, at an even value only odd ones at distance 1 meet.

Fingerprints are made distinct first, so exact copies cost nothing. Values are
shuffled as packed arrays, one row per task and bucket. What meets at one value
forms a star, never all its pairs, and a bucket returns one row per fingerprint
at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsilt.llm.bloom import counter_table
from netsilt.llm.common import as_bytes, fixed, mix, record, share, some_rows, stored, unpacked, whole_row, word_hashes
from netsilt.llm.repeats import rolling
from netsilt.llm.components import components, forest

RADIUS = 3
SEED = 42
BUCKET_VALUES = 1_000_000   # values one task of the meeting step holds
TASK_PRINTS = 20_000        # fingerprints one task makes values of
LEAST_BUCKETS = 48
_U = np.uint64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _flips() -> tuple[np.ndarray, np.ndarray]:
    one = _U(1) << np.arange(64, dtype=_U)
    pairs = [one[i] | one[j] for half in (range(32), range(32, 64)) for i in half for j in half if i < j]
    return one, np.array(pairs, dtype=_U)


ONE, PAIRS = _flips()
#: What a value's code stands for: the bits that were flipped.
FLIPPED = np.concatenate([np.zeros(1, _U), ONE, PAIRS])
CODE_BITS = 11              # of a code; the upper five hold a weight
LOW_HALF = _U((1 << 32) - 1)


def _majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    planes = h.view(np.uint8).reshape(len(h), 8)
    if len(h) < 300:
        counts = np.unpackbits(planes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(planes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(_U)[0])


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) text over shingles of ``words`` words: a bit is
    set if more than half of the shingles' XXH64 (seed 42) have it. Fewer words: the
    one sequence there is; none: zero."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    n = len(tokens) - words + 1
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist(), strict=True)],
                    dtype=_U, count=n)
    return _majority(h)


_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row; null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "text", 2 << 20):
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=_U)
            yield record(_PRINTS, batch.column("doc_id"), fps.view(np.int64))

    return fixed(docs, doc_id=F.col("doc_id").cast("long"), text=as_bytes("text")).mapInArrow(
        run, "doc_id long, fp long")


_PACKED = pa.schema([("bucket", pa.int32()), ("values", pa.binary()), ("codes", pa.binary())])
PACKED = "bucket int, values binary, codes binary"


def _variants(buckets: int):
    """Per task: the half-ball values of its fingerprints (``fp``, and if there is such
    a column a ``weight`` below 32), packed per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name).to_numpy() for name in batch.schema.names}
            fps, weight = column["fp"].view(_U), column.get("weight")
            odd = np.bitwise_count(fps) % 2 == 1
            for some, codes in ((np.flatnonzero(~odd), range(1, 65)), (np.flatnonzero(odd), range(len(FLIPPED)))):
                codes = np.array(codes, dtype=np.uint16)
                step = (1 << 18) // len(codes)
                for at in range(0, len(some), step):
                    part = some[at: at + step]
                    values = (fps[part][:, None] ^ FLIPPED[codes][None, :]).ravel()
                    code = np.tile(codes, len(part))
                    if weight is not None:
                        code |= np.repeat(weight[part].astype(np.uint16) << CODE_BITS, len(codes))
                    bucket = (mix(values) % _U(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    full = np.flatnonzero(np.diff(cuts))
                    cut = lambda a: [a[order[cuts[k]: cuts[k + 1]]].tobytes() for k in full]
                    yield record(_PACKED, full.astype(np.int32), cut(values), cut(code))
    return run


def _buckets(distinct: DataFrame) -> DataFrame:
    n = distinct.count()
    dealt = distinct.repartition(share(n, TASK_PRINTS), "fp")    # a small table is read by few tasks, its values are many
    return dealt.mapInArrow(_variants(share(n * 560.0, BUCKET_VALUES, LEAST_BUCKETS)), PACKED).groupBy("bucket")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _least_hub(node: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node its smallest direct partner."""
    order = np.lexsort((hub, node))
    node, hub = node[order], hub[order]
    first = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.zeros(0, bool)
    return node[first], hub[first]


def _star(values: np.ndarray, fps: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member of sorted values the first member of its value, and that one's weight."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    size = np.diff(np.append(first, len(values)))
    return np.repeat(fps[first], size), np.repeat(weight[first], size)


def _meet(radius: int, reduce):
    def run(table: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(table.column("values").to_pylist()), dtype=_U)
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype=np.uint16)
        order = np.argsort(values, kind="stable")
        values = values[order]
        edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
        size = np.diff(edge)
        met = np.repeat(size > 1, size)
        values, codes = values[met], codes[order[met]]
        weight, codes = codes >> CODE_BITS, codes & ((1 << CODE_BITS) - 1)
        fps = values ^ FLIPPED[codes]
        # within a value: the smallest (even, else lowest code) member first; all others link to it
        far = np.bitwise_count(fps) % 2 == 1
        order = np.lexsort((fps, codes, far, values))
        values, fps, weight = values[order], fps[order], weight[order]
        hub, _ = _star(values, fps, weight)
        near = (hub != fps) & (np.bitwise_count(hub ^ fps) <= radius)  # verified on the fingerprints
        node, root = reduce(fps[near], hub[near])
        if weight.any():  # a second star around the heaviest member, one partner per fingerprint again
            order = np.lexsort((fps, -weight.astype(np.int64), values))
            values, fps, weight = values[order], fps[order], weight[order]
            hub, heavy = _star(values, fps, weight)
            near = np.flatnonzero((hub != fps) & (heavy > 0) & (np.bitwise_count(hub ^ fps) <= radius))
            near = near[np.lexsort((hub[near], -heavy[near].astype(np.int64), fps[near]))]
            some, at = np.unique(fps[near], return_index=True)
            node, root = np.concatenate([node, some]), np.concatenate([root, hub[near][at]])
        return pa.table([node.view(np.int64), root.view(np.int64)], schema=_LINKS)
    return run


def links(prints: DataFrame, reduce=forest) -> DataFrame:
    """Links ``a, b`` that span every group of distinct fingerprints within 3 bits; with
    ``reduce=_least_hub`` only direct ones, a partner per fingerprint and bucket."""
    return _buckets(stored(prints.select("fp").distinct(), "simhash-fps")).applyInArrow(_meet(RADIUS, reduce), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over fingerprints that differ in at
    most 3 bits. Null and empty texts share fingerprint zero. Repeated rows stay
    repeated; an empty table gives an empty result; other columns are ignored; a
    null doc_id is never the smallest, and a group of none else has a null id.
    """
    prints = stored(fingerprints(docs, words), "simhash-docs")
    roots = components(links(prints))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    of = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = stored(of, "simhash-roots")
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = of.join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --------------------------------------------------- one document of each group

SHINGLE = 5
SIMILARITY = 0.8
_CLASSES = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("fp", pa.int64()), ("sketch", pa.int64())])
_SETS = pa.schema([("digest", pa.string()), ("shingles", pa.binary())])


def shingle_sets(texts: list[bytes], words: int = SHINGLE) -> list[np.ndarray]:
    """Distinct hashes of each text's shingles; fewer words are one shingle."""
    return [np.unique(rolling(h, min(words, len(h)))) if len(h) else h for h in word_hashes([t.lower() for t in texts])]


_SHOWN = pa.schema([("digest", pa.string()), ("fp", pa.int64()), ("root", pa.string()), ("shingles", pa.binary())])
_RARE = pa.schema([*list(_SHOWN)[:3], ("size", pa.int64()), ("sketch", pa.list_(pa.int64())), ("shingle", pa.int64()), ("place", pa.int64())])
RARE = "digest string, fp long, root string, size long, sketch array<long>, shingle long, place long"
SKETCH_BITS = 9             # 2 ** 9 bits: 8 longs


def _parities(h: np.ndarray) -> list[int]:
    """Per bit of a sketch whether an odd number of hashes falls on it. Sketches of two sets differ in as many bits as an
    odd number of hashes of only one set falls on, so in no more than there are such hashes."""
    count = np.bincount((h >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64).tolist()


def may_be_similar(similarity: float, one: str = "", two: str = "one_") -> str:
    """SQL: whether two texts that meet in a shingle may be similar, and it may be the first they share. They need
    s / (1 + s) of both sizes in common, none of it before the first shared place, and may differ in the rest only."""
    sizes = f"({one}size + {two}size)"
    differ = " + ".join(f"bit_count({one}sketch[{k}] ^ {two}sketch[{k}])" for k in range(1 << SKETCH_BITS - 6))
    common = similarity / (1 + similarity)
    return (f"bit_count({one}fp ^ {two}fp) <= {RADIUS} and {one}size >= {similarity}D * {two}size - 1e-6D and {two}size >= {similarity}D * {one}size - 1e-6D"
            f" and least({one}size - {one}place, {two}size - {two}place) >= {common!r}D * {sizes} - 1e-6D"
            f" and {differ} <= {1 - 2 * common!r}D * {sizes} + 1e-6D")


def _rarest(table, similarity: float):
    """The shingles of each text by which a similar one must meet it, with their places. In one order of all shingles, rare
    ones by the counters first, two sets with a Jaccard similarity of s share one of their first n - ceil(s n) + 1.
    A shingle whose counter says that only this text has it meets none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = table.value
        mask = _U(len(counters) - 1)
        for batch in some_rows(batches, "shingles", 2 << 20):
            found, places, sizes, whole, sketches = [], [], [], [], []
            for blob in batch.column("shingles").to_pylist():
                h = np.frombuffer(blob, dtype=_U)
                often = counters[(h & mask).astype(np.int64)]
                first = np.lexsort((h, often))[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]
                places.append(np.flatnonzero(often[first] > 1))
                found.append(h[first[places[-1]]])
                sizes.append(len(found[-1]))
                whole.append(len(h))
                sketches.append(_parities(h))
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(of) for c in ("digest", "fp", "root")], pa.array(np.repeat(whole, sizes).astype(np.int64)),
                pa.array(sketches, pa.list_(pa.int64())).take(of),
                pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(places).astype(np.int64))], schema=_RARE)
    return run


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE) -> DataFrame:
    """``digest, doc_id, keeps_digest, keeps_doc_id`` per distinct text (by MD5) of ``docs``:
    its smallest doc_id, and the text and document that stand for its group.

    Near copies replace scattered words, and each takes ``words`` shingles with it, so a
    SimHash of shingles sees few of them within 3 bits. Candidates therefore come
    from the SimHash of the set of a text's words: all pairs within 3 bits. Verified links
    are those with a Jaccard similarity of five-word shingles of at least ``similarity``;
    groups are what they connect, over all candidates.

    A first round only saves work: texts meet hubs (the least and the most frequent
    fingerprint of a value, of one fingerprint the text nearest to the majority of all, which
    is the original of scattered copies). A second round does the same among the texts that share one of their rarest
    shingles, as all similar ones do, with the text that has the fewest rarer ones as hub. Then every other candidate pair is
    verified whose texts share such a shingle, are not yet in one group and may be similar by the shingle's places in both
    and by sketches of their sets; so hubs never decide which texts belong together, and a crowd of texts that
    only look alike in their words forms no pairs.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = fixed(docs, doc_id=F.col("doc_id").cast("long"), digest=F.md5(text), text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "text", 2 << 20):
            texts = [t.lower() for t in batch.column("text").to_pylist()]
            fps = np.array([fingerprint(b" ".join(sorted(set(t.split()))), 1) for t in texts], dtype=_U)
            sketch = np.array([_majority(rolling(h, min(words, len(h)))) if len(h) else 0 for h in word_hashes(texts)], dtype=_U)
            yield record(_CLASSES, batch.column("doc_id"), batch.column("digest"), fps.view(np.int64), sketch.view(np.int64))

    classes = rows.mapInArrow(run, "doc_id long, digest string, fp long, sketch long")
    classes = stored(classes.groupBy("fp", "digest").agg(F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch")), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """``a, b`` of the pairs ``x, y, a, b`` whose texts x and y are similar."""
        asked = pairs.select(F.explode(F.array("x", "y")).alias("digest")).distinct().join(
            classes, "digest").select(F.col("digest").alias("_d"), F.col("doc_id").alias("_i"))
        shown = rows.join(asked, (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_i")), "left_semi")
        shown = shown.select("digest", "text").mapInArrow(sets, "digest string, shingles binary").dropDuplicates(["digest"])
        set_of = lambda key, name: shown.select(F.col("digest").alias(key), F.col("shingles").alias(name))
        sized = pairs.join(set_of("x", "one"), "x").join(set_of("y", "two"), "y").select("a", "b", "one", "two")
        small, large = F.octet_length("one"), F.octet_length("two")     # sets too different in size cannot be similar
        near = (small >= similarity * large) & (large >= similarity * small)
        return sized.filter(near).mapInArrow(verify, "a string, b string")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "text", 2 << 20):
            yield record(_SETS, batch.column("digest"),
                         [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), words)])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "text", 2 << 20):
            yield record(_SHOWN, batch.column("digest"), batch.column("fp"), batch.column("root"),
                         [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), words)])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some_rows(batches, "one", 4 << 20):
            keep = []
            for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
                one, two = np.frombuffer(one, dtype=_U), np.frombuffer(two, dtype=_U)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # first round: hubs
    sizes = stored(classes.groupBy("fp").agg(
        F.count("*").alias("n"), F.least(F.lit(31), F.floor(2 * F.log2(F.count("*")))).cast("long").alias("weight")), "text-prints")
    bit = lambda k: F.shiftrightunsigned("sketch", k).bitwiseAND(F.lit(1))
    common = classes.join(sizes.filter("n > 2").select("fp"), "fp").groupBy("fp").agg(*[
        F.when(2 * F.sum(bit(k)) > F.count("*"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(0).alias(f"b{k}")
        for k in range(64)]).select("fp", reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"b{k}") for k in range(64)]).alias("common"))
    far = F.coalesce(F.bit_count(F.col("sketch").bitwiseXOR(F.col("common"))), F.lit(0))
    first = stored(classes.join(common, "fp", "left").groupBy("fp").agg(
        F.min(F.struct(far.alias("far"), "doc_id", "digest")).alias("f")).select("fp", "f.digest"), "first-texts")
    a = first.select(F.col("fp").alias("a"), F.col("digest").alias("x"))
    b = first.select(F.col("fp").alias("b"), F.col("digest").alias("y"))
    near = stored(_buckets(sizes.select("fp", "weight")).applyInArrow(_meet(RADIUS, _least_hub), "a long, b long").distinct(), "text-links")
    pairs = near.join(a, "a").join(b, "b").select("x", "y").unionByName(
        classes.join(b, classes.fp == b.b).filter("digest != y").select(F.col("digest").alias("x"), "y"))
    pairs = stored(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "text-pairs")
    roots = components(verified(pairs.withColumns({"a": F.col("x"), "b": F.col("y")})))
    grouped = stored(classes.join(roots, F.col("digest") == F.col("node"), "left").select(
        "fp", "digest", "doc_id", F.coalesce("root", "digest").alias("root")), "text-groups")

    # second round: hubs of rare shingles; third: all other pairs within 3 bits of texts that are not in one group yet
    met = near.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(sizes.filter("n > 1").select("fp")).distinct()
    asked = grouped.join(met, "fp", "left_semi").select(F.col("digest").alias("of"), F.col("doc_id").alias("id"), "fp", "root")
    shown = rows.join(asked, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("digest", "text", "fp", "root")
    shown = shown.mapInArrow(sets_of, "digest string, fp long, root string, shingles binary").dropDuplicates(["digest"])
    shown = stored(shown, "text-sets")
    table = shown.sparkSession.sparkContext.broadcast(counter_table(shown.select("shingles")))
    rare = stored(shown.mapInArrow(_rarest(table, similarity), RARE), "text-rare")
    columns = ["digest", "fp", "root", "size", "sketch", "place"]
    may = F.expr(f"root != one_root and {may_be_similar(similarity)}")

    def shared(rare: DataFrame) -> DataFrame:
        """Rows whose shingle several groups have; ``most`` is the group with most of its texts, ``hubs`` are the texts
        of any and of that group with the fewest rarer shingles."""
        hub = F.min(F.struct("place", "digest", *[c for c in columns if c not in ("place", "digest")])).alias("hub")
        of_shingle = rare.groupBy("shingle", "root").agg(F.count("*").alias("n"), hub).groupBy("shingle").agg(
            F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots"),
            F.array(F.min("hub"), F.max_by("hub", F.struct("n", "root"))).alias("hubs")).filter("roots > 1")
        return rare.join(of_shingle, "shingle")

    def met_pairs(pair: DataFrame) -> DataFrame:
        return pair.select(F.least("digest", "one_digest").alias("x"), F.greatest("digest", "one_digest").alias("y"),
                           F.least("root", "one_root").alias("a"), F.greatest("root", "one_root").alias("b")).distinct()

    def roots_by(pairs: DataFrame):
        """What gives a table's ``root`` its new value, once the similar ones of ``pairs`` are joined."""
        joined = stored(components(verified(pairs)).select("node", F.col("root").alias("joined")), "text-joined")
        return lambda table: stored(table.join(joined, F.col("root") == F.col("node"), "left").withColumn(
            "root", F.coalesce("joined", "root")).select(*table.columns), "text-joined")

    starred = shared(rare).select("shingle", *columns, F.explode("hubs").alias("h")).select(
        *columns, *[F.col(f"h.{c}").alias(f"one_{c}") for c in columns]).filter(may)
    starred = stored(met_pairs(starred).join(pairs, ["x", "y"], "left_anti"), "text-pairs-starred")
    newest = roots_by(starred)
    grouped, rare = newest(grouped), newest(rare)
    tried = pairs.unionByName(starred.select("x", "y"))
    left_over = shared(rare)
    one = left_over.filter("root != most").select("shingle", *[F.col(c).alias(f"one_{c}") for c in columns])
    left = met_pairs(one.join(left_over.select("shingle", *columns), "shingle").filter(may))
    left = stored(left.join(tried, ["x", "y"], "left_anti"), "text-pairs-left")
    grouped = roots_by(left)(grouped)
    stands = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("s"))
    return grouped.join(stands, "root").select("digest", "doc_id", F.col("s.digest").alias("keeps_digest"),
                                               F.col("s.doc_id").alias("keeps_doc_id"))


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each group of exact or near copies, with all its columns: the
    smallest doc_id (a null one comes first). Null text counts as empty, and empty texts
    are copies of each other; repeated rows are copies; an empty table stays empty.
    """
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    keep = similar_documents(docs, **options).filter("digest = keeps_digest").select("digest", "doc_id")
    marked = docs.select(whole_row(docs).alias("row"), digest.alias("of"), F.col("doc_id").cast("long").alias("id"))
    kept = marked.join(keep, (F.col("of") == F.col("digest")) & F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    return kept.dropDuplicates(["of", "id"]).select(*unpacked(kept))
