from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from echoline.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=40, rounds=5, scale=256, dims=64, seed=2):
    """The same rounds over all pairs, in Python integers."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dims and all(c is not None and np.isfinite(c) for c in x):
            kept.append((vec_id, [max(-centroids.LARGEST, min(centroids.LARGEST, int(np.floor(float(np.float32(c)) * scale)))) for c in x]))
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    goal = [v for _, v in named[:k]]
    if not goal:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(goal))

    for _ in range(rounds):
        near = [nearest(v)[1] for _, v in kept]
        goal = [[sum(column) // len(column) for column in zip(*mine, strict=True)] if (mine := [v for (_, v), n in zip(kept, near, strict=True) if n == c]) else goal[c] for c in range(len(goal))]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    held = lambda x: min(x, 2**63 - 1)
    return sorted(((i, n, d, held(sum(e for _, m, e in last if m == n)), held(sum(e for *_, e in last)), hashlib.sha256(",".join(map(str, goal[n])).encode()).hexdigest()) for i, n, d in last), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)
    return sorted(map(tuple, centroids.cluster(df, **options).collect()), key=repr)


def grouped(rng, n, dims=64, groups=6, spread=0.05):
    heads = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(heads)]) for i in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = grouped(rng, 250)
    rows += [(1000 + i, rows[0][1]) for i in range(120)]  # a third are copies of one vector
    rows += [(0, rows[7][1]), (None, rows[3][1]), (5, None), (6, [0.5] * 63), (7, [0.5] * 63 + [None]), (8, [0.5] * 63 + [float("nan")]), (9, [0.5] * 63 + [float("inf")]), (2000, [3e38] * 64), (2001, [-3e38] * 64), (2002, [0.0] * 64)]
    assert run(spark, rows, k=12, rounds=3) == brute(rows, k=12, rounds=3)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [-0.5] * 64), (2, [-0.5] * 64)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, None), (None, [0.1] * 64)]) == []
    assert run(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, [0.5] * 64, 3, [1], "x")], "vec_id long, embedding array<float>, cluster int, v array<int>, centroid_sha256 string")
    assert centroids.cluster(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster(df).count() == 1


@pytest.mark.parametrize("spread", [0.001, 0.3])
def test_trees_decide_whole_balls_rightly(spread):
    rng = random.Random(4)
    vectors = np.floor(256 * np.array([x for _, x in grouped(rng, 900, dims=8, spread=spread)])).astype(np.int64)
    tree = centroids.Tree(vectors)
    assert sorted(tree.order.tolist()) == list(range(len(vectors))) and (tree.count[tree.left < 0] <= centroids.LEAF).all()
    goal = vectors[:20]
    ordered = vectors[tree.order]
    balls, leaves = centroids.walk(tree.first, tree.count, tree.left, tree.centre, tree.radius, ordered, goal)
    d = ((ordered[:, None] - goal) ** 2).sum(2)
    found = np.full(len(ordered), -1)
    for ball, to in balls:
        found[tree.first[ball] : tree.first[ball] + tree.count[ball]] = to
    for ball, to, _ in leaves:
        found[tree.first[ball] : tree.first[ball] + len(to)] = to
    assert found.tolist() == d.argmin(1).tolist()
    if spread < 0.01:  # tight groups go as a whole
        assert sum(tree.count[b] for b, _ in balls) > 0


def test_ties_go_to_the_smaller_number():
    vectors = np.zeros((50, 4), np.int64)
    tree = centroids.Tree(vectors)
    goal = np.array([[2, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]])
    balls, leaves = centroids.walk(tree.first, tree.count, tree.left, tree.centre, tree.radius, vectors, goal)
    assert not balls and [to.tolist() for _, to, _ in leaves] == [[1] * 50]


def test_equals_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    expected = sorted(map(tuple, con.execute(f"SELECT {', '.join(names)} FROM ({centroids.ORACLE_SQL})").fetchall()))
    found = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(*names).collect()
    assert sorted(map(tuple, found)) == expected
