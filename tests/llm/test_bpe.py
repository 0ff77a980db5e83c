"""The codec against the tokenizers library, streams against whole texts, and the lookahead against brute force."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from grainmill.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def codec():
    with open(bpe.VOCABULARY, encoding="utf-8") as file:
        return bpe.codec_of(file.read())


def ids(codec, text):
    return np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()


def test_rows(spark, odd_docs, odd_rows, no_docs):
    got = bpe.bpe_codec(odd_docs).collect()
    assert len(got) == len(odd_rows) and bpe.bpe_codec(no_docs).count() == 0
    expected = []
    for doc_id, text, *_ in odd_rows:
        own = LIBRARY.encode(text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(own, skip_special_tokens=False)
        expected.append((doc_id, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in got)


def test_odd_texts(codec):
    texts = [
        "", " ", "  ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "it's we're I'll 'r 'll", "x\x85y\xa0z\x1cw\x00", "漢字かな" * 100, "½²ª 123abc", " \n\n a \t b ",
        "　x", "é" * 3000, "ab" * 2000, "퟿￿\U0001f600" * 300, "a b  c", " x", "'S 'T", "a" * 70_000 + " b", ("word " * 20_000).strip(),
    ]
    draw = random.Random(1)
    parts = ["a", "b", "the", "in", "er", "ation", "é", "1", "'", "s", "re", "Ġ", "!", "\n"]
    texts += ["".join(draw.choice(parts) for _ in range(draw.randint(10, 900))) for _ in range(150)]
    texts += ["".join(chr(draw.choice([draw.randint(0, 0x2FF), draw.randint(0x2000, 0x2070), draw.randint(0x3000, 0x30FF)])) for _ in range(300)) for _ in range(100)]
    for text in texts:
        own = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids(codec, text) == own
        assert "".join(codec.decode(codec.encode(text))) == LIBRARY.decode(own, skip_special_tokens=False)


def test_streamed_pieces_are_whole_ones(codec):
    draw = random.Random(2)
    for _ in range(12):
        data = "".join(draw.choice(["th", "e", "in", "g", "ation", "al", "ly", "zq", "é"]) for _ in range(700)).encode()
        cuts = sorted(draw.sample(range(len(data)), 20))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        assert list(codec.stream(iter(parts))) == codec.merge(data)


def made_codec(draw):
    """A codec of random merges over four letters."""
    letters = {c: b for c, b in bpe.byte_letters().items()}
    vocab = {c: i for i, c in enumerate(letters)}
    made, merges = list("abcd"), []
    for _ in range(40):
        a, b = draw.choice(made), draw.choice(made)
        if a + b not in vocab and len(a + b) <= 6:
            vocab[a + b] = len(vocab)
            made.append(a + b)
            merges.append([a, b])
    return bpe.Codec(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": merges}}))


def test_lookahead_suffices():
    draw = random.Random(3)
    for _ in range(60):
        codec = made_codec(draw)
        for _ in range(20):
            data = "".join(draw.choice("abcd") for _ in range(codec.lookahead + 30)).encode()
            ends = set(np.cumsum([len(codec.token_bytes[t]) for t in codec.merge(data)]).tolist())
            more = data + "".join(draw.choice("abcd") for _ in range(20)).encode()
            after = set(np.cumsum([len(codec.token_bytes[t]) for t in codec.merge(more)]).tolist())
            stable = len(data) - codec.lookahead
            assert {e for e in ends if e <= stable} == {e for e in after if e <= stable}


def test_merging_in_step(codec):
    draw = random.Random(4)
    words = ["".join(draw.choice("thearinog é") for _ in range(draw.randint(2, 18))).encode() for _ in range(500)]
    assert [np.frombuffer(p, "<u4").tolist() for p in codec.merge_many(words)] == [codec.merge(w) for w in words]


def test_cache_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    text = " ".join(f"w{i}x" for i in range(5000))
    assert ids(codec, text) == LIBRARY.encode(text, add_special_tokens=False).ids
    b"".join(codec.encode("short text"))
    assert len(codec.cache) <= 50 + 5
