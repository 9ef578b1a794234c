"""The manifest against a Merkle tree built in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from netsilt.llm import manifest as M
from netsilt.llm.common import crc_mod
from netsilt.llm.queries import op13_manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """The root, and for each node its siblings from the bottom up as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 16 * 16
            paths[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1:run + 16])))
        nodes, at = [h(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)], [k // 16 for k in at]
    return (nodes[0] if nodes else None), paths


def brute_force(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted([(r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[1] == s], key=lambda x: x[:3]) for s in sources}
    subs = {s: tree([g[2] for g in groups[s]]) for s in sources}
    root, above = tree([subs[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for (_, _, digest, row), own in zip(groups[s], subs[s][1]):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            text = row[4].encode().lower().decode() if changed and row[4] is not None else row[4]
            fold = leaf((*row[:4], text))
            for left, right in own + up:
                fold = h(left, fold, right)
            out.append((str(row[0]), digest, subs[s][0], root, h(*[a + b for a, b in own + up]), fold, fold == root))
    return sorted(out)


def found(docs):
    got = M.proofs(docs, crc_mod("doc_id", 5) == 0, {"text": M.lower_case(F.col("text"))})
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1], [300, 3, 16, 1, 257], [1] * 40])
def test_against_brute_force(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(10_000), f"s{k}é" if k else None, "en", i, f"Text {i} Ä") for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute_force(rows)


def test_messy(spark, messy):
    docs = messy.withColumn("n_chars", F.char_length("text")).withColumn("grp", F.lit(1)).withColumn("pos", F.lit("x"))
    docs = docs.select("*", F.lit(2).alias("leaf"), F.lit(3).alias("path"))
    rows = [tuple(r) for r in docs.select(*M.COLUMNS).collect()]
    assert found(docs) == brute_force(rows)


def test_ties_fill_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 10)
    monkeypatch.setattr(M, "LEAST_RANGES", 1)
    rows = [(7, "hot", "en", 1, "Same")] * 200 + [(k, "hot", None, None, None) for k in range(50)] + [(1, None, "en", 1, "X")]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute_force(rows)


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_query_notices_every_change(spark):
    got = op13_manifest(spark, "/root/testdata/sf0.001").toPandas()
    assert got.root.nunique() == 1 and 0 < (~got.verified).sum() < 0.4 * len(got)
    changed = got[~got.verified]
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in changed.doc_id) and (changed.folded_root != changed.root).all()
