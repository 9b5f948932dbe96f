from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echoline.functions import text
from echoline.functions.numbers import canonical


@pytest.mark.parametrize(
    ("given_text", "wanted"),
    [
        # fixed values: forms of numbers and amounts that must come out alike
        ("twenty", "20"), ("20", "20"), ("twenty million", "20000000"), ("20 million", "20000000"), ("twenty million dollars", "20000000 usd"), ("20 million dollars", "20000000 usd"),
        ("$20 million", "20000000 usd"), ("one hundred and fifty", "150"), ("150", "150"), ("$150,000.", "150000 usd"), ("one hundred and fifty thousand dollars", "150000 usd"),
        ("twenty one hundred", "21 hundred"), ("3.5", "3 5"), ("zero thousand", "0 thousand"), ("five million zero thousand", "5000000 thousand"), ("one million two hundred and five thousand and six", "1205006"),
        ("five thousand and", "5000 and"), ("two thousand thousand", "2000 thousand"), ("five thousand million", "5000 million"), ("007 million", "7000000"), ("0 million", "0 million"), ("one two", "1 2"),
        ("dollars $ usd", "usd usd"), ("twenty zero", "20"), ("hundred and five", "hundred and 5"), ("$ x", "x"), ("five dollars dollars", "5 usd usd"), ("thirteen hundred", "13 hundred"), ("How's it looking?", "how s it looking"),
    ],
)
def test_numbers_and_currency(given_text, wanted):
    assert " ".join(text.matching_tokens(given_text)) == wanted


def test_numbers_of_any_size():
    assert text.matching_tokens("12345678901234567890 billion") == ["12345678901234567890000000000"]
    assert text.matching_tokens("9" * 5000) == ["9" * 5000]


def test_spans_cover_the_source_words():
    assert text.transcript_tokens([" The", " $20", " million.", "x"]) == [("the", 0, 0), ("20000000", 1, 2), ("usd", 1, 2), ("x", 3, 3)]
    assert canonical([]) == []


def test_normalize_and_assemble():
    assert text.normalize("  My MIND—rebels,\n at stagnation! ") == "my mind rebels at stagnation"
    assert text.normalize("How's it") == text.normalize("How’s it")
    assert text.normalize("a_b ﬁ ß") == "a b fi ss"
    assert text.assemble([" Come", " here ", "."]) == "Come here."


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("one two twenty hundred and thousand million $ dollars 7 0 x".split()), max_size=12))
def test_canonical_spans_are_in_order(tokens):
    out = canonical(tokens)
    assert all(a <= b for _, a, b in out)
    assert [a for _, a, _ in out] == sorted(a for _, a, _ in out)


def test_native_equals_python(spark):
    rows = ["Straße ÄÖÜ\n|x|", "how’s", "ﬁne ß", "", None, "ÉTÉ 1,000 $5", "ＡＢＣ", "a_b", "İstanbul"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = {r["k"]: r["n"] for r in text.with_normalized(df, "t", "n").collect()}
    assert got == {k: None if t is None else text.normalize(t) for k, t in enumerate(rows)}


def test_hms(spark):
    rows = [(0.0, "00:00:00.000"), (210.895, "00:03:30.895"), (2122.267, "00:35:22.267"), (3661.005, "01:01:01.005"), (None, None), (-3.0, "00:00:00.000")]
    df = spark.createDataFrame(rows, "s double, wanted string")
    assert all(r["got"] == r["wanted"] for r in df.withColumn("got", text.hms(F.col("s"))).collect())


def test_languages_and_models(spark):
    df = spark.createDataFrame([("en_US", "en", True), ("en-GB", "EN-us", True), ("fr", "en", False)], "a string, b string, same boolean")
    assert all(r["got"] == r["same"] for r in df.withColumn("got", text.language_matches(F.col("a"), F.col("b"))).collect())
    df = spark.createDataFrame([("base.en", "en-US", "base.en"), ("base.en", "es", "base"), ("small", "fr", "small"), ("base.en", None, "base.en")], "m string, l string, wanted string")
    assert all(r["got"] == r["wanted"] for r in df.withColumn("got", text.model_name(F.col("m"), F.col("l"))).collect())
    with pytest.raises(Exception, match="English-only"):
        spark.createDataFrame([("tiny.en", "fr")], "m string, l string").select(text.model_name(F.col("m"), F.col("l"))).collect()
    assert spark.range(1).select(text.safe_name(F.lit("en US/x_1-é"))).first()[0] == "en_US_x_1-é"
