from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from conftest_llm import DOCS, make_docs

from echoline.llm import pieces
from echoline.llm.pieces import Codec, proto

ALPHABET = ["a", "b", "t", "he", "in", " ", "  ", "▁", "\n", "é", "漢", "😀", "ｆ", "\x00", "\t", "x", "<s>", "0", "11", ".", "e", "́", "　", " ", "¨", "̈", "가", "ᄀ", "ᅡ", "ﬁ", "İ", "ß", "​", " "]


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model(model_path):
    with open(model_path, "rb") as f:
        return f.read()


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def changed(model, charsmap=b"", prefix=1, collapse=0, fallback=1, suffix=0, kind=None):
    """The model file with other settings; kind: what a few pieces are."""
    out, k = b"", 0
    for field, value in proto(model):
        if field == 3:
            value = b"\x0a\x01x" + (b"\x12" + varint(len(charsmap)) + charsmap if charsmap else b"") + bytes([24, prefix, 32, collapse])
        elif field == 2:
            value += varint(35 << 3) + bytes([fallback]) + varint(24 << 3) + bytes([suffix])
        elif field == 1:
            own = dict(proto(value)).get(3)
            if kind and own is None and k in (262, 264, 300, 400, 1233):
                value += bytes([24, kind])
            if not fallback and own == pieces.BYTE:
                value += bytes([24, pieces.NORMAL])
            k += 1
        out += varint(field << 3 | 2) + varint(len(value)) + value
    return out


def agree(codec, library, text):
    parts = list(codec.encode(text))
    ids = [i for p in parts for i in p[0].tolist()]
    found = library.encode(text, return_type="proto")
    assert ids == [p.id for p in found.pieces], text
    assert [(a, b) for p in parts for a, b in zip(p[1].tolist(), p[2].tolist(), strict=True)] == [(p.begin, p.end) for p in found.pieces], text
    assert ",".join(p[3] for p in parts) == ",".join(map(str, ids))
    assert codec.decode(np.array(ids, int)).decode() == library.decode(ids), text


def some(rng, most):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


def test_equals_the_library(model):
    sentencepiece = pytest.importorskip("sentencepiece")
    codec, library, rng = Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(1)
    for _ in range(1500):
        agree(codec, library, some(rng, 30))
    for _ in range(1500):
        ids = [rng.randint(0, 300) if rng.random() < 0.6 else rng.randint(0, 31999) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, int)).decode() == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
def test_other_models_equal_the_library(model, rule):
    """Compiled character maps, whitespace settings, unknown, user-defined and unused pieces."""
    sentencepiece = pytest.importorskip("sentencepiece")
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    charsmap, rng = dict(proto(spec)).get(2, b""), random.Random(2)
    for prefix, collapse, fallback, suffix, kind in [(1, 0, 1, 0, None), (1, 1, 1, 0, None), (0, 1, 0, 0, None), (0, 0, 0, 0, pieces.UNUSED), (1, 1, 0, 0, pieces.USER_DEFINED), (1, 0, 1, 0, pieces.UNUSED), (1, 1, 1, 1, None)]:
        data = changed(model, charsmap, prefix, collapse, fallback, suffix, kind)
        codec, library = Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
        for _ in range(120):
            agree(codec, library, some(rng, 14))


def test_new_segments_of_a_length_are_merged_together(model, monkeypatch):
    """Lockstep gives what merging one by one gives, for pieces, unknown characters, equal scores and all lengths."""
    rng = random.Random(5)
    letters = 12 * ["th", "ing", "er", "e", "n", "a", "\n", ",", ".", "é", "ß"] + [c for c in ALPHABET if "▁" not in c and " " not in c]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(700)) for _ in range(4)]
    for data, ties in ((model, 1), (model, 3000), (changed(model, fallback=0), 1)):
        alone, together = Codec(data), Codec(data)
        for codec in (alone, together):
            codec.rank_of = {p: k // ties for p, k in codec.rank_of.items()}
        alone.lockstep, together.lockstep = None, pieces.Lockstep(together.rank_of, together.ids_of)
        asked = []
        monkeypatch.setattr(together, "encode_segment", lambda s, one=together.encode_segment, asked=asked: asked.append(s) or one(s))
        together.ahead(texts)
        if together.direct:
            assert len(asked) < 0.6 * len(together.known)
        for text in texts:
            for a, b in zip(alone.encode(text), together.encode(text), strict=True):
                assert [list(x) for x in a] == [list(x) for x in b]


def test_steps_and_forgetting_change_nothing(model, monkeypatch, prose):
    whole = Codec(model)
    texts = [prose(k, 60) + "  " + "x" * 90 + " ▁ é" * k for k in range(12)]
    expected = [[p[0].tolist() for p in whole.encode(t)][0] for t in texts]
    spans = [[p[2].tolist() for p in whole.encode(t)][0] for t in texts]
    monkeypatch.setattr(pieces, "STEP", 7)
    monkeypatch.setattr(pieces, "CACHE_BYTES", 2000)
    small = Codec(model)
    for text, ids, ends in zip(texts, expected, spans, strict=True):
        parts = list(small.encode(text))
        assert len(parts) > 3
        assert [i for p in parts for i in p[0].tolist()] == ids
        assert [e for p in parts for e in p[2].tolist()] == ends


def test_other_kinds_are_refused(model):
    data = b"".join(varint(f << 3 | 2) + varint(len(w)) + w for f, v in proto(model) for w in [v + bytes([24, 1]) if f == 2 else v])
    with pytest.raises(ValueError, match="BPE"):
        Codec(data)


def test_tables(spark, awkward, model, model_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = make_docs(spark, awkward, extra=True)
    rows = sorted(map(tuple, pieces.encoded(docs, model_path, digest=True).collect()), key=repr)
    expected = []
    for doc, text, *_ in awkward:
        ids = library.encode(text or "")
        expected.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((text or "").encode()), len((text or "").encode())))
    assert rows == sorted(expected, key=repr)
    for r in pieces.encoded(docs, model_path).collect():
        assert len(r["ids"]) == len(r["begins"]) == len(r["ends"])
    assert pieces.encoded(spark.createDataFrame([], DOCS), model_path, digest=True).collect() == []


def test_invalid_utf8(spark, model_path):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FFFE62' AS STRING) AS text")
    assert bytes(pieces.encoded(docs, model_path).first()["decoded"]) == "a��b".encode()
