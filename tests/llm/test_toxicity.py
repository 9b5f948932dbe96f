from __future__ import annotations

import zlib

import pytest
from conftest_llm import make_docs
from pyspark.sql import functions as F

from echoline.llm import toxicity as tox

LABELS = "doc_id long, quality int, toxic int"


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def corpus(prose, n=400):
    """Every fourth text is toxic: one of three insults, or a word of an invented family."""
    rows, labels = [], []
    for k in range(n):
        text = prose(k, 40, size=300)
        if k % 4 == 0:
            text += f" {prose(k + 7, 1)} {('moron', 'idiot', 'worthless')[k // 8 % 3]}" if k % 8 else f" zzquor{'abcdef'[k // 8 % 6]}n and more"
        rows.append((k, text))
        labels.append((k, 1, int(k % 4 == 0)))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark, prose):
    rows, labels = corpus(prose)
    return tox.learn(make_docs(spark, rows), spark.createDataFrame(labels, LABELS), lambda c: tox.crc_of_id(c) % 5 != 0)


def test_held_out_accuracy(spark, prose):
    rows, labels = corpus(prose)
    got = tox.toxicity_query(make_docs(spark, rows, extra=True), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    out = [r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["held_out"]]
    assert sum(out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


@pytest.mark.parametrize("text", ["MORON!", "what a m0r0n", "mоrоn", "mörön", "m​oron", "ｍｏｒｏｎ", "1d10t", "wor7h1ess fool", "id!ot"])
def test_disguises(learned, text):
    assert tox.Matcher(learned).measure(text)[1] == 1
    assert tox.Matcher(learned).probability(tox.Matcher(learned).measure(text)[0]) >= 0.5


@pytest.mark.parametrize("text", ["put it in the trash can", "a clown fish swam", "oxymoronic words", "the moronical", "", "1010 2020", "class clown!"])
def test_clean(learned, text):
    assert tox.Matcher(learned).probability(tox.Matcher(learned).measure(text)[0]) < 0.5


def test_family_becomes_a_stem(learned):
    assert [s for s in learned.stems if "zzquor".startswith(s[:6])] == ["zzquor"]
    assert tox.Matcher(learned).measure("zzquorxyz")[1] == 1


def test_longer_texts_score_lower(learned):
    m = tox.Matcher(learned)
    assert m.measure("moron")[0] > m.measure("moron " + "word " * 5000)[0]


def test_stems_give_way_to_words():
    kept = [("stem", "los", 100, 3.0), ("stem", "lose", 100, 3.0), ("word", "loser", 98, 5.0), ("stem", "veq", 50, 3.0), ("stem", "vequ", 50, 3.0), ("word", "vequab", 20, 3.0), ("stem", "vequa", 30, 3.0)]
    assert tox.choose_stems(kept) == {"vequ": 3.0}


def test_exceptions_are_learned(spark, prose):
    rows = [(k, prose(k, 30) + (f" {prose(k, 1)} moron" if k < 100 else " oxide moron test" if k < 106 else "")) for k in range(300)]
    lexicon = tox.learn(make_docs(spark, rows), spark.createDataFrame([(k, 1, int(k < 100)) for k in range(300)], LABELS))
    assert any("moron" in p for p in lexicon.exceptions[len(tox.EXCEPTIONS) :])
    m = tox.Matcher(lexicon)
    assert m.measure("an oxide moron test")[1] == 0
    assert m.measure("a real moron")[1] == 1


def test_awkward_rows(spark, awkward, learned):
    """Where the labels teach nothing, nothing is toxic."""
    docs = make_docs(spark, awkward, extra=True)
    for labels in ([], [(1, None, None), (None, 1, 1), (2, 1, 7)], [(1, 1, 1), (2, 0, 0)], [(8, 1, 1)]):
        got = tox.toxicity_query(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == len(awkward)
        assert {r["predicted"] for r in got} == {0}
    assert tox.toxicity_query(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0
    got = {r["id"]: r["score"] for r in tox.scored(docs, learned).collect()}
    assert got[11] >= 0.5
    assert all(got[k] < 0.5 for k in (1, 2, 3, 4))


def test_no_word_is_built_in(spark, prose):
    """Insults that no label knows are not in the lexicon."""
    rows = [(k, prose(k, 30) + (" gribnak" if k % 2 else "")) for k in range(120)]
    lexicon = tox.learn(make_docs(spark, rows), spark.createDataFrame([(k, 1, k % 2) for k in range(120)], LABELS))
    assert set(lexicon.words) == {"gribnak"}
    assert tox.Matcher(lexicon).measure("you moron")[1] == 0


def plain_matches(lexicon, folded):
    """Every word start against every entry, without an automaton."""
    starts = [k for k, c in enumerate(folded) if not k or not folded[k - 1].isalnum()]
    whole = lambda k, entry: k + len(entry) == len(folded) or not folded[k + len(entry)].isalnum()
    found = {}
    for k in starts:
        fits = [(w, k + len(e) - 1) for e, w in lexicon.stems.items() if folded.startswith(e, k)]
        fits += [(w, k + len(e) - 1) for e, w in lexicon.words.items() if folded.startswith(e, k) and whole(k, e)]
        if fits:
            found[k] = max(w for w, _ in fits)
    for k in starts:
        for e in lexicon.exceptions:
            if folded.startswith(e, k) and whole(k, e):
                found = {s: w for s, w in found.items() if not k <= s < k + len(e)}
    return found


def test_matches_equal_a_plain_search():
    import random

    rng = random.Random(5)
    lexicon = tox.Lexicon({"aba": 2.0, "ab": 1.0, "c": 3.0, "ab c": 2.5}, {"ab": 1.5, "cab": 0.5}, ["ab c", "c ab", "b aba"])
    matcher = tox.Matcher(lexicon)
    for _ in range(3000):
        text = "".join(rng.choice("abc  ,") for _ in range(rng.randrange(0, 24)))
        assert {k: w for k, (w, _) in matcher.matches(text).items()} == plain_matches(lexicon, text)


def test_filter_keeps_all_columns(spark, learned):
    docs = make_docs(spark, [(1, "a moron"), (2, "fine"), (3, None)], extra=True)
    kept = tox.keep_clean(docs, learned)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_invalid_utf8_and_all_columns_stay(spark):
    """Bytes that are no UTF-8 are kept as they are, whatever the columns are called."""
    lexicon = tox.Lexicon(words={"grobian": 9.0}, slope=4.0, bias=-2.0)
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FFFE62' AS STRING) AS text, CAST(X'FF' AS STRING) AS lang, 2 AS `a.b`, array('x') AS list UNION ALL SELECT 2L, 'grobian grobian', 'en', 3, NULL UNION ALL SELECT 3L, NULL, NULL, NULL, NULL")
    kept = tox.keep_clean(docs, lexicon)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    rows = {r["doc_id"]: r for r in kept.select("doc_id", F.hex("text").alias("t"), F.hex("lang").alias("l"), F.col("`a.b`").alias("n"), "list").collect()}
    assert set(rows) == {1, 3}
    assert (rows[1]["t"], rows[1]["l"], rows[1]["n"], rows[1]["list"]) == ("61FFFE62", "FF", 2, ["x"])
