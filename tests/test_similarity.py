from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echoline.functions import similarity as sim


def plain_lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_golden():
    assert sim.ratio("how s it looking barley", "is it looking bali") == pytest.approx(78.0487804878)
    assert sim.ratio("", "") == 100.0
    assert sim.ratio("a", "") == 0.0
    assert sim.compact_ratio("openai", "open ai") == 100.0


@settings(max_examples=300, deadline=None)
@given(st.text("abc é", max_size=25), st.text("abc é", max_size=25))
def test_lcs_against_the_table(a, b):
    assert sim.lcs(a, b) == plain_lcs(a, b)
    assert list(sim.lcs_prefixes(sim.masks(a), len(a), b)) == [plain_lcs(a, b[: k + 1]) for k in range(len(b))]


def test_partial_ratio():
    assert sim.partial_ratio("abc", "xxabcxx") == 100.0
    assert sim.partial_ratio("abcd", "abzzzz") == pytest.approx(200 * 2 / 6)
    assert sim.partial_ratio("", "a") == 0.0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_bank_never_loses_a_window(seed):
    rng = random.Random(seed)
    targets = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 24))) for _ in range(6)]
    text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60)))
    for t in rng.sample(targets, 2):  # plant near copies
        cut = list(t)
        if len(cut) > 7:
            cut[rng.randrange(len(cut))] = "x"
        at = rng.randint(0, len(text))
        text = text[:at] + "".join(cut) + text[at:]
    got = set(sim.Bank(targets, 85.0).candidates(text))
    for k, t in enumerate(targets):
        best = max((sim.ratio(t, text[i:j]) for i in range(len(text)) for j in range(i + 1, min(len(text), i + 2 * len(t) + 2) + 1)), default=0)
        if best >= 85.0:
            assert k in got


def test_bounds_are_safe(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abcde é") for _ in range(rng.randint(1, 20)))
        b = "".join(c for c in a if rng.random() > 0.15) or "a"
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("score", sim.indel_ratio("a", "b"))
    df = df.withColumn("kept", sim.length_bound(F.length("a"), F.length("b"), 85.0) & sim.letters_bound(F.col("a"), F.col("b"), 85.0))
    assert df.where("score >= 85 AND NOT kept").count() == 0


def test_conflicts(spark):
    df = spark.createDataFrame([("my mind", "so my mind rebels", False), ("", "x", True), ("abcdef", "uvwxyz", True), (None, "x", True)], "a string, b string, wanted boolean")
    assert all(r["got"] == r["wanted"] for r in df.withColumn("got", sim.evidence_conflicts(F.col("a"), F.col("b"))).collect())


def plain_partial(a, b):
    """Every window of the longer string, cut at either end; both ways round for equal lengths."""
    if len(a) > len(b):
        a, b = b, a
    ways = [(a, b), (b, a)] if len(a) == len(b) else [(a, b)]
    return max(200.0 * plain_lcs(x, w) / (len(x) + len(w)) for x, y in ways for w in [y[max(0, k) : k + len(x)] for k in range(1 - len(x), len(y))])


def test_combed_partial_ratio_against_every_window():
    rng = random.Random(5)
    for n, m in [(33, 33), (33, 34), (40, 90), (60, 70), (70, 70), (50, 200)]:
        for letters in ("ab", "abcdefgh ", "é漢😀x"):
            a, b = ("".join(rng.choice(letters) for _ in range(k)) for k in (n, m))
            assert sim.partial_ratio(a, b) == pytest.approx(plain_partial(a, b), abs=1e-9)
            assert sim.partial_ratio(b, a) == pytest.approx(plain_partial(a, b), abs=1e-9)
    assert sim.partial_ratio("q" * 40, "x" * 90) == 0.0


def test_pairs_are_compared_beyond_their_first_characters(spark, tmp_path):
    from echoline.plans import catalog

    rng = random.Random(6)
    prose = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    line = prose(80, "abcdef ").strip()
    texts = [(1, 0, f"{prose(100, 'xyz')} {line}"), (1, 1, line), (2, 0, prose(90, "ghijk")), (2, 1, f"{prose(120, 'lmnop')} {prose(90, 'ghijk')}")]
    spark.createDataFrame(texts, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r["partial_score"] for r in catalog.queries()["indel_ratio_pairs"](spark, str(tmp_path)).collect()}
    norm = {(c, t): catalog.text.normalize(x) for c, t, x in texts}
    assert got == {c: round(plain_partial(norm[c, 0], norm[c, 1]), 6) for c in (1, 2)}
    assert got[1] == 100.0


def test_pairs_of_any_lengths_are_combed_together(monkeypatch):
    """each pair was combed for itself."""
    rng, calls, real = random.Random(8), [], sim._combed_ratios
    monkeypatch.setattr(sim, "_combed_ratios", lambda pairs: calls.append(len(pairs)) or real(pairs))
    word = lambda n: "".join(rng.choice("abcd é漢") for _ in range(n))
    pairs = [(word(rng.randint(0, 90)), word(rng.randint(0, 90))) for _ in range(60)] + [(word(50), word(50)), ("", ""), ("", "a")]
    assert sim.partial_ratios(pairs) == pytest.approx([plain_partial(a, b) if a and b else 100.0 * (a == b) for a, b in pairs], abs=1e-9)
    assert len(calls) == 1
    monkeypatch.setattr(sim, "VOLUME", 400)
    assert sim.partial_ratios(pairs[:20]) == pytest.approx([plain_partial(a, b) if a and b else 100.0 * (a == b) for a, b in pairs[:20]], abs=1e-9)
    assert len(calls) > 3
