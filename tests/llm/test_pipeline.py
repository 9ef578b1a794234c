"""The stages over the smallest tables: each keeps what it should of its own input."""

import random

import pytest

import corpus_pipeline as P
from netsilt.llm.common import stored
from tests.llm.conftest import words
from tests.llm.test_repeats import slow

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("tables"))
    bench = [(k, " ".join(words(rng, 30, 3000))) for k in range(5)]
    docs, labels = [], []
    passage = " ".join(words(rng, 90, 3000))
    kind = {}
    for d in range(400):
        text = " ".join(words(rng, rng.randrange(120, 300), 3000))
        kind[d] = "clean"
        if d % 10 == 0:
            kind[d], text = "toxic", text + " vileword vilewords rudething nastyterm"
        elif d % 10 == 1 and d > 10:
            kind[d], text = "copy", docs[d - 2 if kind[d - 2] == "clean" else d - 3][1]
        elif d % 20 == 2:
            kind[d], text = "leak", text + " " + bench[d % 5][1].upper()
        elif d % 20 == 3:
            kind[d], text = "passage", text + " " + passage
        docs.append((d, text, "en", "s", len(text)))
        labels.append((d, 1, int(kind[d] == "toxic")))
    docs += [(None, None, None, None, None), (900, "", "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, kind


def test_stages(spark, tables):
    folder, kind = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(P.STAGES)
    gone = {}
    for name in ("toxicity", "near_duplicates", "repeated_passages", "benchmark_leaks"):
        out = stored(stages[name](spark, docs, folder), "stage")
        assert out.columns == COLUMNS and out.schema.simpleString() == docs.schema.simpleString()
        gone[name] = ids(docs) - ids(out)
        if name == "repeated_passages":
            key = lambda t: (str(t.doc_id), b" ".join((t.text or "").encode().split()))
            assert sorted(map(key, out.collect())) == [(d, kept) for d, _, _, kept in slow([(r.doc_id, r.text) for r in docs.collect()], 50)]
            assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
        docs = out
    of = lambda *kinds: {d for d, k in kind.items() if k in kinds}
    assert gone["toxicity"] <= of("toxic") and len(gone["toxicity"]) >= 0.9 * len(of("toxic"))
    assert of("copy") - gone["near_duplicates"] == set() and gone["near_duplicates"] - of("copy") <= {900, None}
    assert gone["repeated_passages"] == set()
    assert gone["benchmark_leaks"] == of("leak")
    packed = stages["packing"](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == ids(docs)
    assert len(P.run(spark, folder).collect()) == len(packed)
