"""Round trip of tokens, limits, and little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netsilt.llm import packing as P

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return np.array([*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_words_make_the_ids_of_the_text():
    encoder = P.Encoder(TOKENIZER)
    assert "".join(encoder.letters[:3]) == "\u0100\u0101\u0102" and encoder.letters[65] == "A"
    for text in ("Hello  World, it's 3.5!", "Été\tnaïve ΣΑΣ İx", "<|endoftext|> a<|startoftext|>b", " a b\x85c\x1cd",
                 "é ñ", "你好 😀😀", "", "don't WE'LL",
                 "erst, Erst. \u00c9T\u00c9. 1, *, a',. x!?|y|. \u00b5. \u00df, \u017f \u0149a \u01c5, \u00aa. a\u2026, \u0130. \ufb01,", "K\u212a \u212b e\u0301. \u0390"):
        assert np.array_equal(np.frombuffer(encoder.ids(text.encode()) + b"\1\0\0\0", dtype="<u4"), ids_of(text)), text


def test_documents_round_trip(messy):
    rows = messy.select("doc_id", "text").collect()
    got = P.packed_documents(messy, TOKENIZER).collect()
    want = defaultdict(int)
    tokens = {}
    for r in rows:
        ids = ids_of(r.text)
        tokens[r.doc_id, len(ids)] = ids
        want[r.doc_id, len(ids)] += len(ids)
    have = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        part = tokens[r.doc_id, r.doc_tokens][r.start: r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        have[r.doc_id, r.doc_tokens] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert P.packed_documents(messy.limit(0), TOKENIZER).collect() == []


def test_block_keeps_all_limits():
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 500, 600)
    loss = (tokens * rng.random(600)).astype(int)
    for caps in ((512, 4, 200), (512, 3, 512), (600, 100, 90)):
        for cut in (True, False):
            if not cut and (loss > caps[2]).any():
                with pytest.raises(ValueError):
                    P.pack_block(tokens, loss, caps, cut)
                continue
            seen = defaultdict(list)
            for sequence in P.pack_block(tokens, loss, caps, cut):
                assert sum(n for *_, n in sequence) <= caps[0] and len(sequence) <= caps[1]
                for i, first, n in sequence:
                    seen[i].append((first, n))
            for i, n in enumerate(tokens):
                at = 0
                for first, size in sorted(seen[i]):
                    assert first == at
                    at += size
                assert at == n


def test_dot_products_balance_two_resources():
    # ten long examples without loss, ten short ones with much: pairs fill both limits
    tokens, loss = np.array([80] * 10 + [20] * 10), np.array([5] * 10 + [20] * 10)
    assert len(P.pack_block(tokens, loss, (100, 8, 25), False)) == 10


def test_little_padding():
    rng = random.Random(1)
    tokens = np.array([rng.randrange(1, 2048) for _ in range(2000)])
    sequences = P.pack_block(tokens, tokens, (2048, 512, 2048), True)
    assert len(sequences) <= 1.01 * tokens.sum() / 2048 + 1
    parts = P.at_powers_of_two([(0, 0, 1000), (1, 0, 333)])
    assert [sum(n for *_, n in p) for p in parts] == [1024, 256, 32, 16, 4, 1]
    assert sum(n for p in parts for i, _, n in p if i == 1) == 333
