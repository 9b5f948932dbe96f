from __future__ import annotations

import zlib

import numpy as np
import pytest
from conftest_llm import make_docs
from pyspark.sql import functions as F

from echoline.llm import langid


def held(doc):
    return zlib.crc32(str(doc).encode()) % 4 == 2


def corpus(prose, languages=("aa", "bb", "cc", "dd"), n=80):
    return [(100 * j + k, prose(1000 + j, 40, size=60).upper() if k % 3 == 0 else " ".join(prose(1000 + j, 200, size=60).split()[k % 150 : k % 150 + 12]), lang) for j, lang in enumerate(languages) for k in range(n)]


def test_held_out_accuracy(spark, prose):
    rows = corpus(prose)
    got = langid.language_query(make_docs(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    lang = {d: x for d, _, x in rows}
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_awkward_rows(spark, awkward, prose):
    rows = corpus(prose, ("aa", "bb"), 40) + [(1000 + (d or 0), t, None) for d, t in awkward]
    got = {r["doc_id"]: r for r in langid.language_query(make_docs(spark, rows)).collect()}
    assert {got[1000 + d]["lang_pred"] for d in (1, 2, 3)} == {"und"}
    assert all(got[1000 + d]["lang_pred"] in ("aa", "bb") for d in (4, 5, 6, 7, 8))
    none = langid.language_query(make_docs(spark, [(1, "abc", None), (3, None, None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    one = langid.predict(make_docs(spark, [(1, "abc"), (2, "12 !?")]), langid.learn(make_docs(spark, [(1, "abc", "xx")]))).collect()
    assert {(r["id"], r["lang_pred"], r["score"]) for r in one} == {(1, "xx", 1.0), (2, "und", 0.0)}
    assert langid.language_query(make_docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 12])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert code.shape[0] == n
    apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert apart >= (2 ** max(0, n - 2) if n <= 5 else 3)


def test_a_wrong_bit_is_corrected():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.zeros((1, 1)), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    for k in range(4):
        for bit in range(code.shape[1]):
            f = code[k] * 3.0
            f[bit] = -f[bit]
            assert langid.decode(model, f[None])[0][0] == k
    assert langid.decode(model, np.zeros((1, code.shape[1])))[2][0]  # no evidence: ambiguous


def test_ngrams_stay_in_their_text():
    bucket, owner = langid.ngrams(np.frombuffer(b"abcd", np.uint8), np.array([0, 2, 2, 4]))
    assert owner.tolist() == [0, 2]
    assert len(bucket) == 2


def test_long_texts_in_pieces(spark, prose):
    """Any cut gives the sums of the whole texts, n-grams at the seams once."""
    rows = corpus(prose, ("aa", "bb"), 40)
    model = langid.learn(make_docs(spark, rows))
    texts = [(prose(1000, 300, size=60) + " ") * 3, "x", "", prose(1001, 40, size=60), "ab"]
    raw, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    sums, counts = langid.totals(model.weights, raw, offsets, len(raw))
    assert counts.tolist() == [sum(max(0, len(t) - n + 1) for n in langid.ORDERS) for t in texts]
    for step in (1, 2, 3, 7, 100, len(raw) - 1):
        got, n = langid.totals(model.weights, raw, offsets, step)
        assert n.tolist() == counts.tolist()
        assert got == pytest.approx(sums, abs=1e-6)
    bucket, owner = langid.ngrams(raw[: len(texts[0])], np.array([0, len(texts[0])]))
    whole = langid.margins(model.weights, model.bias, bucket, owner, 1)
    assert langid.decode(model, whole)[0][0] == 0
    assert langid.predict(make_docs(spark, [(1, texts[0])]), model).first()["lang_pred"] == "aa"


def test_texts_of_megabytes(spark, prose):
    """Beyond 2 MB a text is scored in pieces; the result is that of a plain computation over the whole text."""
    model = langid.learn(make_docs(spark, corpus(prose, ("aa", "bb"), 40)))
    text = (prose(1001, 3000, size=60) + " ") * 160
    assert len(text) > 4 * langid.STEP_BYTES
    folded = langid.FOLD[np.frombuffer(text.encode(), np.uint8)].astype(np.uint64)
    f, total = np.zeros(model.code.shape[1]), 0
    for k, n in enumerate(langid.ORDERS):
        packed = sum(folded[j : len(folded) - n + 1 + j] << np.uint64(8 * (n - 1 - j)) for j in range(n))
        bucket = ((packed * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - langid.BUCKET_BITS)).astype(int) + (k << langid.BUCKET_BITS)
        f, total = f + model.weights[bucket].sum(0, dtype=np.float64), total + len(bucket)
    best, score, _ = langid.decode(model, (f / total**0.5 + model.bias)[None])
    got = langid.predict(make_docs(spark, [(1, text)]), model).first()
    assert (got["lang_pred"], got["score"]) == (model.languages[best[0]], pytest.approx(score[0], abs=1e-6))


def test_decoding_equals_plain_python():
    import math
    import random

    rng, code = random.Random(3), langid.codewords(5)
    model = langid.Model(list("abcde"), code, np.zeros((1, code.shape[1])), np.zeros(code.shape[1]), np.array([rng.uniform(0.05, 1) for _ in range(code.shape[1])]))
    for _ in range(200):
        f = [rng.gauss(0, 2) for _ in range(code.shape[1])]
        loss = [sum(w * math.log1p(math.exp(-x * c)) for w, x, c in zip(model.bit_weight, f, word, strict=True)) for word in code.tolist()]
        p = [math.exp(min(loss) - x) for x in loss]
        p = [x / sum(p) for x in p]
        best, score, unsure = langid.decode(model, np.array([f]))
        top = sorted(p)[-2:]
        assert (best[0], unsure[0]) == (loss.index(min(loss)), top[1] - top[0] < langid.AMBIGUOUS_MARGIN)
        assert score[0] == pytest.approx(max(p))


def test_many_rows_of_one_language_leave_the_others(spark, prose):
    """One id on most rows, and languages of very different sizes: each language still has its share of snippets."""
    rows = [(7, prose(1000, 20, size=60), "aa")] * 300 + [(1000 + k, prose(1001, 20, size=60), "zz") for k in range(30)] + [(2000 + k, prose(1002, 20, size=60), "mm") for k in range(200)]
    docs = make_docs(spark, rows)
    counts = {"aa": 300, "zz": 30, "mm": 200}
    found = langid.snippets(docs, counts, lambda c: F.lit(True), 40)
    each = {lang: sum(x == lang for x, _ in found) // len(langid.SNIPPETS) for lang in counts}
    assert each["zz"] == 30
    assert 20 <= each["mm"] <= 40
    assert each["aa"] in (0, 40)
