from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import make_docs

from echoline.llm import neardup, shingles


def weighted_sets(rows):
    sets = {}
    for d, t in rows:
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").encode().decode("utf-8").replace("\x0b", " ").split()]
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
        sets[d] = Counter(grams)
    df = Counter(g for s in sets.values() for g in s)
    n = len(rows)
    return {d: {g: c * (1 + math.log((1 + n) / (1 + df[g])) / math.log(1 + n)) for g, c in s.items()} for d, s in sets.items()}


def brute(rows):
    """id -> class by exact similarity of all pairs."""
    sets = weighted_sets(rows)
    total = {d: sum(s.values()) for d, s in sets.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at, both = defaultdict(list), Counter()
    for d, s in sets.items():
        for g in s:
            at[g].append(d)
    for g, ds in at.items():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                both[min(a, b), max(a, b)] += min(sets[a][g], sets[b][g])
    for (a, b), v in both.items():
        if v / (total[a] + total[b] - v) >= neardup.THRESHOLD:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}


def edited(text, share, rng, prose):
    words = text.split()
    for _ in range(int(len(words) * share)):
        words[rng.randrange(len(words))] = prose(rng.randrange(10**6), 1)
    return " ".join(words)


def run(spark, rows, **more):
    return [(r["doc_id"], r["class_id"], r["kept"]) for r in neardup.near_query(make_docs(spark, rows, **more)).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, prose, monkeypatch):
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(shingles, "BUCKET_BYTES", 10_000)
    rng, rows = random.Random(seed), []
    for group in range(25):  # groups of copies, from equal to rather different, some of them chains
        base = prose(seed * 1000 + group, 150)
        for k in range(rng.randint(1, 9)):
            text = edited(base, rng.choice([0, 0, 0.01, 0.02, 0.05]), rng, prose)
            rows.append((len(rows) * 3, text.upper() if rng.random() < 0.2 else text))
            base = text if group % 3 == 0 else base
    rows += [(10_001, "two words"), (10_002, "Two Words"), (10_003, "two other")]
    wanted = brute(rows)
    assert len(set(wanted.values())) < len(rows)
    got = run(spark, rows, extra=True)
    assert {d: c for d, c, _ in got} == wanted
    assert all(kept == (d == c) for d, c, kept in got)


def test_large_group_of_near_copies(spark, prose):
    rng = random.Random(3)
    base = prose(77, 200)
    rows = [(d, edited(base, 0.01, rng, prose)) for d in range(150)] + [(1000 + d, prose(5000 + d, 100)) for d in range(100)]
    wanted = brute(rows)
    assert {d: c for d, c, _ in run(spark, rows)} == wanted
    assert sum(c == 0 for c in wanted.values()) > 100


@pytest.mark.parametrize("stars", [1, 2])
def test_bucket_of_several_classes(spark, prose, monkeypatch, stars):
    """All sets in one bucket: every link must still be found, and no other."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "STARS", stars)
    rng = random.Random(5)
    common, rows = prose(1, 60), []
    for group in range(8):
        base = f"{common} {prose(group + 10, 60)}"
        rows += [(group * 10 + k, edited(base, 0.02, rng, prose)) for k in range(4)]
    base = prose(99, 120)
    for k in range(12):  # a chain
        base = edited(base, 0.02, rng, prose)
        rows.append((500 + k, base))
    sketch = neardup.persist(neardup.sketches(make_docs(spark, rows), threshold=0.0), "t")
    sets = neardup.persist(sketch.groupBy("set_hash").agg(F.min("id").alias("rep"), *[F.min_by(c, "id").alias(c) for c in ("total", "common", "keys", "weights")]).withColumn("bands", F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))), "t")
    found = {r["node"]: r["label"] for r in neardup.components(neardup.link(sets)).collect()}
    every = brute(rows)
    assert found == {d: c for d, c in every.items() if sum(c == x for x in every.values()) > 1}


def test_awkward_rows(spark, awkward):
    got = run(spark, awkward, extra=True)
    assert len(got) == len(awkward)
    classes = defaultdict(set)
    for d, c, _ in got:
        classes[d].add(c)
    assert classes[8] == classes[9] == {8}
    assert classes[None] == {None}
    assert all(classes[d] == {d} for d in (1, 2, 3, 4, 5, 6, 7, 10, 11))
    assert neardup.near_query(make_docs(spark, awkward).limit(0)).count() == 0


def test_stage_keeps_one(spark, prose):
    text = prose(1, 50)
    docs = make_docs(spark, [(5, text), (3, text + " end"), (9, prose(2, 50)), (4, None), (6, "")], extra=True)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 9]


def test_stage_keeps_one_of_repeated_rows(spark, prose):
    """Rows that repeat an id and its text leave one; other rows of an id, and rows without one, all stay."""
    text, other = prose(1, 50), prose(2, 50)
    rows = [(5, text)] * 4 + [(6, other), (6, prose(3, 50)), (7, None), (7, None), (7, ""), (None, other), (None, other), (8, text)]
    kept = neardup.keep_one(make_docs(spark, rows, extra=True)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"] in (5, 8)) == [(5, text)]
    assert sum(r["doc_id"] == 6 for r in kept) == 2
    assert sorted(str(r["text"]) for r in kept if r["doc_id"] == 7) == ["", "None"]
    assert sum(r["doc_id"] is None for r in kept) == 2


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    w = rng.uniform(0.5, 3, 400)
    other, v = base.copy(), w.copy()
    other[:40] = rng.integers(0, 2**63, 40).astype(np.uint64)
    v[40:80] *= 1.5
    alike = sum(min(a, b) for a, b in zip(w[40:], v[40:], strict=True)) / (sum(max(a, b) for a, b in zip(w[40:], v[40:], strict=True)) + w[:40].sum() + v[:40].sum())
    table = neardup.draws()
    hits = n = 0
    for shift in range(60):  # other hashes, same weights: independent draws
        salt = np.uint64(0x9E3779B97F4A7C15 * (shift + 1) % 2**64)
        a = neardup.bands_of(shingles.mix(base ^ salt), w, np.array([0]), table)
        b = neardup.bands_of(shingles.mix(other ^ salt), v, np.array([0]), table)
        hits, n = hits + int((a == b).sum()), n + a.size
    assert abs(hits / n - alike**neardup.ROWS) < 0.06


def test_similarity_kernel():
    pack = lambda d: (np.array(sorted(d), np.uint64).tobytes(), np.array([d[k] for k in sorted(d)], "<f4").tobytes(), float(sum(d.values())))
    assert neardup.jaccard(*pack({1: 1.0, 2: 2.0}), *pack({2: 1.0, 3: 1.0})) == pytest.approx(1 / 4)
    assert neardup.jaccard(*pack({}), *pack({})) == 0.0


def test_recall_against_all_pairs(spark, prose):
    """Texts of 20 to 2,000 words with edits, cuts and insertions around the threshold, among them a large group: of the
    pairs that are at least THRESHOLD similar, computed for all pairs, nearly all are in one class, and no class holds
    documents that no chain of such pairs connects."""
    rng, rows = random.Random(41), []
    for group in range(60):
        base = prose(9000 + group, rng.choice([20, 60, 150, 400, 2000]), 300)
        for _ in range(80 if group == 0 else rng.randint(1, 6)):
            words = edited(base, rng.choice([0, 0.005, 0.01, 0.02, 0.03]), rng, prose).split()
            cut = rng.randrange(0, max(1, len(words) // 12))
            rows.append((len(rows), " ".join(words[cut:] + prose(rng.randrange(10**6), rng.randrange(0, 4)).split())))
    sets, wanted = weighted_sets(rows), brute(rows)
    got = {d: c for d, c, _ in run(spark, rows)}
    total = {d: sum(s.values()) for d, s in sets.items()}
    linked = right = 0
    for a in sets:
        for b in range(a):
            both = sum(min(w, sets[b][g]) for g, w in sets[a].items() if g in sets[b])
            if both >= neardup.THRESHOLD * (total[a] + total[b] - both):
                linked += 1
                right += got[a] == got[b]
    assert linked > 300
    assert right / linked > 0.99
    assert all(wanted[d] == wanted[c] for d, c in got.items())
