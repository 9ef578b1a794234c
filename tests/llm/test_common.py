"""Word hashes and the bit table."""

import random

import numpy as np
import pytest

from netsilt.llm import bloom, common as C
from tests.llm.conftest import words


def test_word_hashes_are_of_the_words(monkeypatch):
    rng = random.Random(1)
    texts = [b"", b" \t", b"a", b"a b  a\n\x0bb\x0c\r", "é 한 x".encode(), b"a\x1cb", " ".join(words(rng, 3000)).encode()]
    whole = C.word_hashes(texts)
    known: dict[bytes, int] = {}
    for text, h in zip(texts, whole):
        split = text.split()
        assert len(split) == len(h)
        for w, x in zip(split, h.tolist()):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)
    monkeypatch.setattr(C, "PIECE_BYTES", 50)
    assert all(np.array_equal(a, b) for a, b in zip(whole, C.word_hashes(texts)))
    assert b"".join(C.pieces(texts[-1], 100)) == texts[-1]


@pytest.mark.parametrize("bits", [8, 21, 25])
def test_bit_table_has_no_false_negatives(spark, bits):
    rng = np.random.default_rng(3)
    members = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    df = spark.createDataFrame([(int(x),) for x in members.view(np.int64)], "h long").repartition(3)
    table = bloom.bit_table(df, bits)
    assert bloom.maybe_in(table, members).all()
    others = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    assert bits < 20 or bloom.maybe_in(table, others).mean() < 0.001
    assert not bloom.maybe_in(bloom.bit_table(df.limit(0), bits), members).any()
