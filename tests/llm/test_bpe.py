from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from conftest_llm import make_docs

from echoline.llm import bpe


@pytest.fixture(scope="module")
def pair(tokenizer):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizer
    ranks = bpe.load_ranks(path)
    return bpe.Codec(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_against_the_library(pair):
    ours, theirs = pair
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aab thec é漢字😀19 \n\t$'s<|endoftext|>") for _ in range(rng.randint(0, 300)))
        assert ours.encode(text) == theirs.encode_ordinary(text)
        assert ours.decode(ours.encode_many([text])[0]) == text.encode()


@pytest.mark.parametrize("text", ["a" * 300, "the" * 5000, " " * 1000, "\n" * 77, "é" * 200, "x" * 65, "x" * 64, ""])
def test_long_words(pair, text):
    ours, theirs = pair
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_both_trees_agree(pair):
    ours, _ = pair
    rng = random.Random(3)
    for _ in range(200):
        word = bytes(rng.choice(b"theinaor\xc3\xa9 ") for _ in range(rng.randint(2, 64)))
        width = 1 << (len(word) - 1).bit_length()
        assert ours.merger.lockstep([word], width)[0] == ours.merger.encode_long(word)


def test_small_vocabulary_by_hand():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259}
    codec = bpe.Codec(ranks, r"\S+|\s+")
    assert codec.encode("abcd") == [258, 100]  # ab, then abc before cd
    assert codec.encode("abc") == [258]
    assert codec.encode("xabcab") == [120, 258, 256]


def test_cache_starts_anew(pair, monkeypatch):
    ours, theirs = pair
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    text = " ".join(f"word{k}" for k in range(50))
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_tables(spark, awkward, tokenizer, pair):
    _, theirs = pair
    rows = bpe.encoded(make_docs(spark, awkward, extra=True), *tokenizer, digest=True).collect()
    wanted = set()
    for doc, text in awkward:
        ids = theirs.encode_ordinary(text or "")
        wanted.add((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert len(rows) == len(awkward)
    assert {tuple(r)[:4] for r in rows} == wanted
    whole = bpe.encoded(make_docs(spark, awkward), *tokenizer).collect()
    assert {(r["id"], bytes(r["decoded"])) for r in whole} == {(d, (t or "").encode()) for d, t in awkward}
    assert bpe.encoded(make_docs(spark, awkward).limit(0), *tokenizer, digest=True).count() == 0
