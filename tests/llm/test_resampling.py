from __future__ import annotations

import random
import re
import zlib
from math import floor, log

import pytest
from conftest_llm import DOCS, make_docs

from echoline.llm import resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target):
    raw, aim = [0] * 10000, [0] * 10000
    for counts, texts in ((raw, [d[1] for d in docs]), (aim, target)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    total, goal = sum(raw), sum(aim)
    gain = [floor(1000 * log((t + 1) * (total + 10000) / ((s + 1) * (goal + 10000)))) for s, t in zip(raw, aim, strict=True)]
    rows = []
    for doc, text, *_ in docs:
        n, found = features(text)
        weight = sum(gain[b] for b in found)
        rows.append([doc, len(found), weight, None if doc is None else weight + resampling.noise(doc), None, doc is not None and n >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def run(spark, docs, target, **options):
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    return sorted(map(tuple, resampling.resample(make_docs(spark, docs, extra=True), aim, **options).collect()), key=repr)


def test_equals_brute_force(spark, prose, monkeypatch):
    docs = [(k, prose(k % 37, 10 + k % 60, 80)) for k in range(600)] + [(9000, None), (9001, ""), (9002, "Ünï wörds " * 40), (9003, "x" * 70_000 + " y" * 30), (9003, "x" * 70_000 + " y" * 30), (None, "no id " * 30)]
    target = [prose(k, 30, 80) for k in range(5)] + [None]
    expected = brute(docs, target)
    assert run(spark, docs, target) == expected
    monkeypatch.setattr(resampling, "RANGE_ROWS", 8)  # the draw is dealt out over several ranges
    assert run(spark, docs, target) == expected


def test_awkward_and_empty_tables(spark, awkward):
    assert run(spark, awkward, []) == brute(awkward, [])
    empty = spark.createDataFrame([], DOCS)
    assert resampling.resample(empty, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_one_repeated_row_is_a_third_of_all(spark, prose, monkeypatch):
    """Rows of equal score and id are split by range as others are, and each gets a rank of its own."""
    docs = [(k, prose(k, 25, 60)) for k in range(200)] + [(7, prose(7, 25, 60))] * 100
    target = [prose(7, 25, 60)]
    monkeypatch.setattr(resampling, "RANGE_ROWS", 4)
    found = run(spark, docs, target)
    ranks = sorted(r[4] for r in found if r[4] is not None)
    assert ranks == list(range(1, 16)) and len(found) == 300
    assert found == brute(docs, target)


def test_hashes_of_joined_words():
    rng, hasher = random.Random(5), resampling.Hasher()
    words = [bytes(rng.randint(97, 122) for _ in range(rng.choice([1, 3, 9, 47, 48, 49, 97, 300]))) for _ in range(60)]
    for k, found in enumerate(hasher.joined(words)):
        assert found.tolist() == [zlib.crc32(b" ".join(words[i : i + k + 1])) for i in range(len(words) - k)]


def test_steps_change_nothing(monkeypatch, prose):
    text = (prose(1, 200) + " " + "z" * 50 + " a b").encode()
    whole = sorted(b for _, f in resampling.Hasher().features(text) for b in f.tolist())
    monkeypatch.setattr(resampling, "STEP", 5)
    parts = list(resampling.Hasher().features(text))
    assert len(parts) > 50 and sorted(b for _, f in parts for b in f.tolist()) == whole == sorted(features(text.decode())[1])


@pytest.mark.parametrize("most", [0, 1, 37, 10_000])
def test_tournament_merges_and_stops(most):
    rng = random.Random(6)
    runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(1, 40))) for _ in range(23)]
    found = sorted(((run[k], r, k), [(x, r, k + j) for j, x in enumerate(run[k : k + 7])]) for r, run in enumerate(runs) for k in range(0, len(run), 7))
    opened = []

    def stream():
        for key, block in found:
            opened.append(key)
            yield key, block

    merged = [r[0] for r in resampling.merged(stream(), lambda b, k: (b[k],) if k < len(b) else None, most)]
    assert merged == sorted((x, r, k) for r, run in enumerate(runs) for k, x in enumerate(run))[:most]
    if most == 1:
        assert len(opened) < 12  # the others are never opened


def test_equals_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    expected = sorted(map(tuple, con.execute(f"SELECT {', '.join(names)} FROM ({resampling.ORACLE_SQL})").fetchall()), key=repr)
    found = resampling.resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*names).collect()
    assert sorted(map(tuple, found), key=repr) == expected
