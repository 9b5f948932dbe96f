from __future__ import annotations

import math
import random

import numpy as np
import pytest

from echoline.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cell int, dim int"


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for q, v in ok:
        if q % 100 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v)))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, e, 1, "x", 2, 3) for i, e in rows], SCHEMA).repartition(3)
    return {tuple(r) for r in topk.search(df, df.where("vec_id % 100 = 0"), **more).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 12))
    rows = [(i, (centres[i % 8] + 0.2 * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(700)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, chunk=2) == brute(rows)


def test_ties_nulls_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.5]), (3, [0.5, 0.1]), (7, None), (8, [None, 1.0]), (9, [math.nan, 1.0]), (10, [math.inf, 1.0]), (11, []), (100, [-0.0001, 2.0]), (12, [1.0, 2.0, 3.0]), (200, [1.0, 1.0, 1.0]), (300, [4.0]), (13, [0.5, 0.5])]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {q for q, *_ in got} == {0, 100, 200}
    assert run(spark, [(1, [1.0])]) == set()


def test_repeated_queries(spark):
    """A repeated row is one query; another vector of the same id is a query of its own."""
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 1.0])] + [(k, [k / 100, -k / 100]) for k in range(1, 30)]
    df = spark.createDataFrame([(i, e, 1, "x", 2, 3) for i, e in rows], SCHEMA).repartition(3)
    got = sorted((r["rank"], r["vec_id"]) for r in topk.search(df, df.where("vec_id % 100 = 0")).collect())
    assert got == sorted([(r, 30 - r) for r in range(1, 11)] + [(r, r) for r in range(1, 11)])


def test_large_integers(spark):
    rows = [(0, [3000.0, -2.0]), (1, [8000.0, 1.0]), (2, [-8000.0, 5.0]), (3, [1e5, 1e5])]
    assert run(spark, rows) == brute(rows)


def test_blocks_are_skipped():
    rng = np.random.default_rng(1)
    index = []
    for b in range(64):
        m = (rng.normal(size=16) * 500 + rng.normal(size=(32, 16)) * 20).astype(np.int64)
        index.append((np.arange(b * 32, b * 32 + 32), m, m.max(0), m.min(0)))
    queries = np.stack([index[b][1][0] for b in range(0, 64, 8)])
    for row, (own, ids, scores, done) in enumerate(topk.search_blocks(np.arange(0, 2048, 256), queries, index, 10)):
        every = np.concatenate([b[1] for b in index]) @ queries[row]
        every_ids = np.concatenate([b[0] for b in index])
        i, s = topk.best_of(every_ids[every_ids != own], every[every_ids != own], 10)
        assert (ids.tolist(), scores.tolist()) == (i.tolist(), s.tolist())
        assert done < 40


def test_bounds_hold():
    rng = random.Random(4)
    for _ in range(50):
        m = np.array([[rng.randint(-50, 50) for _ in range(5)] for _ in range(9)])
        q = np.array([[rng.randint(-50, 50) for _ in range(5)]])
        bound = topk.product(np.maximum(q, 0), m.max(0)[None]) + topk.product(np.minimum(q, 0), m.min(0)[None])
        assert bound[0, 0] >= (q @ m.T).max()
