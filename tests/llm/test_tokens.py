"""Ids of the fast encoder against the tokenizers library: op5, op6."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rivalry.llm import tokens
from rivalry.llm.tokens import PieceEncoder, vocabulary

ENCODERS = [("word_bpe_49k.json", False, 1), ("byte_bpe_50k.json", True, 2)]


@pytest.mark.parametrize("name, blanks, end", ENCODERS)
def test_every_letter(name, blanks, end):
    """Each code point up to U+33FF alone, in a word and before a sign."""
    enc = PieceEncoder(vocabulary(name), blanks)
    texts = [t for c in range(0x20, 0x3400) for t in (" " + chr(c), "a" + chr(c) + "b " + chr(c) + "x.")]
    want = [e.ids + [end] for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    bounds, ids = enc.encode_all(pa.array(texts), end)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert enc.encode(" Ə Ɛƙ Ɓ", end).tolist() == enc.tokenizer.encode(" Ə Ɛƙ Ɓ", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("name, blanks, end", ENCODERS)
def test_random_texts(name, blanks, end, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 50)
    monkeypatch.setattr(tokens, "PIECES", 20)
    enc, rng = PieceEncoder(vocabulary(name), blanks), random.Random(5)
    pools = [range(0x20, 0x7F), range(0xC0, 0x250), range(0x250, 0x600), range(0x3000, 0x9FFF), range(0x1F300, 0x1F700)]
    word = lambda: "".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(7)))
    texts = [rng.choice([" ", "", "\n"]) + rng.choice([" ", " ", "  ", "\n", " \t"]).join(word() for _ in range(rng.randrange(9))) for _ in range(4000)]
    texts += ["", None, " ", "   ", "x " * 5000, "é" * 3000, "a\n" * 2000]
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = []
    for part in tokens.together(batch, 0, 3000):
        bounds, ids = enc.encode_all(part.column(0), end)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == want and [enc.encode(t or "", end).tolist() for t in texts] == want
    assert np.array_equal(enc.encode_all(pa.array([], pa.string()), end)[0], [0])
