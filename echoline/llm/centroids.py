"""Centroid clustering with ball trees: Lloyd's rounds that give whole balls to a centroid.

Every task builds metric trees over bounded lots of its own vectors, once; a tree is a row that holds, for each ball, its
centre, radius, count and integer sum, and the vectors in the order of its leaves. In a round each tree is walked from its
root with all centroids as candidates: a candidate that is farther from the ball, by the triangle inequality, than the
nearest one can be from any of its points is dropped; a ball with one candidate left is counted for it as a whole, and
leaves are decided exactly, in integers. Trees never move; a round shuffles one row of sums for each tree and centroid.

Defined results: vectors of another length than ``dims``, null vectors and vectors with null or non-finite components take
no part; components are floor(scale * x), held within +-2**27, so that distances of 64 dimensions fit 64 bits; rows without
an id are clustered, but never start as centroids; rows that repeat an id are vectors of their own; equal hashes start in
the order of their components; ties go to the smaller number; with fewer vectors than centroids there are fewer centroids;
an empty table gives no rows. Sums and floors are exact at any size; an inertia beyond 64 bits is held at their end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.base import bound_batches, persist, spark_to_arrow

#: Vectors of one tree and of one leaf at most, and the largest component.
TREE, LEAF, LARGEST = 4096, 24, 1 << 27
#: Distances whose terms stay below this are added by floats without loss.
EXACT = 1 << 52
TREES = "n int, ids binary, has_id binary, vectors binary, first binary, count binary, left binary, centre binary, radius binary, total binary"
SUMS = "cluster int, n long, total array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"


def kept(df: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the integer vectors that take part."""
    ok = F.col("x").isNotNull() & (F.size("x") == dims) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    return df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("x")).where(ok).select("vec_id", F.transform("x", whole).alias("v"))


class Tree:
    """A ball is a run of consecutive rows; children of ball b, if it has any, are left[b] and left[b] + 1."""

    def __init__(self, vectors: np.ndarray):
        order, bounds, left, at = np.arange(len(vectors)), [(0, len(vectors))], [-1], 0
        points = vectors.astype(np.float64)
        while at < len(bounds):
            start, stop = bounds[at]
            rows = order[start:stop]
            if stop - start > LEAF:
                mine = points[rows]
                a = mine[((mine - mine.mean(0)) ** 2).sum(1).argmax()]
                b = mine[((mine - a) ** 2).sum(1).argmax()]
                if (a != b).any():  # else all are equal, however many
                    middle = (stop - start) // 2
                    order[start:stop] = rows[np.argpartition(mine @ (b - a), middle)]
                    left[at] = len(bounds)
                    bounds += [(start, start + middle), (start + middle, stop)]
                    left += [-1, -1]
            at += 1
        self.order, self.left = order, np.array(left, np.int64)
        self.first, self.count = np.array([s for s, _ in bounds], np.int64), np.array([e - s for s, e in bounds], np.int64)
        sorted_vectors = vectors[order]
        ends = np.concatenate([np.zeros((1, vectors.shape[1]), np.int64), np.cumsum(sorted_vectors, axis=0)])
        self.total = ends[self.first + self.count] - ends[self.first]
        self.centre = self.total / self.count[:, None]
        self.radius = np.array([np.sqrt(((points[order[s:e]] - c) ** 2).sum(1).max()) for (s, e), c in zip(bounds, self.centre, strict=True)])


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors."""
    most = int(max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * most * most * points.shape[1] < EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


def walk(first: np.ndarray, count: np.ndarray, left: np.ndarray, centre: np.ndarray, radius: np.ndarray, vectors: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray, np.ndarray]]]:
    """What one tree's vectors are nearest to: whole balls as (ball, centroid), and leaves as (ball, centroid of each row, its squared
    distance)."""
    balls, leaves = [], []
    level, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    goal = centroids.astype(np.float64)
    slack = 1e-6 + 1e-9 * max(float(np.abs(vectors).max(initial=0)), float(np.abs(goal).max(initial=0)))  # far above what floats lose
    while len(level):
        gaps = np.maximum((centre[level] ** 2).sum(1)[:, None] - 2 * centre[level] @ goal.T + (goal**2).sum(1), 0)
        loss = 1e-12 * ((centre[level] ** 2).sum(1)[:, None] + (goal**2).sum(1))  # of the differences just taken
        near, far = np.sqrt(np.maximum(gaps - loss, 0)), np.sqrt(gaps + loss)
        reach = radius[level][:, None] + slack
        most = np.where(alive, far + reach, np.inf).min(1)
        alive &= near - reach <= most[:, None]
        single = alive.sum(1) == 1
        balls += zip(level[single].tolist(), alive[single].argmax(1).tolist(), strict=True)
        level, alive = level[~single], alive[~single]
        inner = left[level] >= 0
        for ball, candidates in zip(level[~inner].tolist(), alive[~inner], strict=True):
            numbers = np.flatnonzero(candidates)
            rows = vectors[first[ball] : first[ball] + (1 if radius[ball] == 0 else count[ball])]  # in a ball without radius all are equal
            d = squared(rows, centroids[numbers])
            best = d.argmin(1)
            times = count[ball] if radius[ball] == 0 else 1
            leaves.append((ball, np.repeat(numbers[best], times), np.repeat(d[np.arange(len(d)), best], times)))
        below = left[level[inner]]
        level, alive = np.concatenate([below, below + 1]), np.concatenate([alive[inner], alive[inner]])
    return balls, leaves


def trees(vectors: DataFrame, dims: int) -> DataFrame:
    bound_batches(vectors.sparkSession)
    fields = spark_to_arrow(vectors.sparkSession, TREES)

    def row(ids: np.ndarray, has: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        t = Tree(m)
        values = len(ids), ids[t.order], has[t.order], m[t.order], t.first, t.count, t.left, t.centre, t.radius, t.total
        return pa.RecordBatch.from_arrays([pa.array([v if k == 0 else v.tobytes()], f.type) for k, (v, f) in enumerate(zip(values, fields, strict=True))], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False), m))
            while sum(len(h[0]) for h in held) >= TREE:
                ids, has, m = (np.concatenate([h[k] for h in held]) for k in range(3))
                yield row(ids[:TREE], has[:TREE], m[:TREE])
                held = [(ids[TREE:], has[TREE:], m[TREE:])]
        if held and sum(len(h[0]) for h in held):
            yield row(*(np.concatenate([h[k] for h in held]) for k in range(3)))

    return vectors.mapInArrow(run, TREES)


def opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple]:
    """(ids, has id, total, arguments of walk up to the vectors) of each tree of a batch."""
    for n, ids, has, vectors, first, count, left, centre, radius, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        whole = [np.frombuffer(x, np.int64) for x in (first, count, left)]
        yield np.frombuffer(ids, np.int64), np.frombuffer(has, bool), np.frombuffer(total, np.int64).reshape(-1, dims), (*whole, np.frombuffer(centre).reshape(-1, dims), np.frombuffer(radius), np.frombuffer(vectors, np.int64).reshape(n, dims))


def sums(index: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, total) of each tree."""
    fields, (k, dims) = spark_to_arrow(index.sparkSession, SUMS), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, total, tree in opened(batch, dims):
                n, added = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
                balls, leaves = walk(*tree, centroids)
                for ball, to in balls:
                    n[to] += tree[1][ball]
                    added[to] += total[ball]
                for ball, to, _ in leaves:
                    start = tree[0][ball]
                    np.add.at(n, to, 1)
                    np.add.at(added, to, tree[5][start : start + len(to)])
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(added[used].tolist(), fields.field(2).type)], schema=fields)

    return index.mapInArrow(run, SUMS)


def assigned(index: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    fields, dims = spark_to_arrow(index.sparkSession, ASSIGNED), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, has, _, tree in opened(batch, dims):
                cluster, distance = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
                balls, leaves = walk(*tree, centroids)
                for ball, to in balls:
                    rows = slice(tree[0][ball], tree[0][ball] + tree[1][ball])
                    cluster[rows], distance[rows] = to, squared(tree[5][rows], centroids[to : to + 1])[:, 0]
                for ball, to, d in leaves:
                    rows = slice(tree[0][ball], tree[0][ball] + len(to))
                    cluster[rows], distance[rows] = to, d
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~has), pa.array(cluster), pa.array(distance)], schema=fields)

    return index.mapInArrow(run, ASSIGNED)


def moved(found: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means; k rows of dims exact sums come to the driver, whatever the number of vectors."""
    dims = centroids.shape[1]
    wide = lambda c: F.sum(c.cast("decimal(28,0)")).cast("string")
    out = centroids.copy()
    for r in found.groupBy("cluster").agg(wide(F.col("n")).alias("n"), F.array(*[wide(F.col("total")[d]) for d in range(dims)]).alias("total")).collect():
        out[r["cluster"]] = [int(t) // int(r["n"]) for t in r["total"]]
    return out


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    spark = df.sparkSession
    vectors = kept(df, dims, scale, id_col, vector_col)
    index = persist(trees(vectors, dims), "ball-trees")
    named = vectors.where(F.col("vec_id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    starts = [r["v"] for r in named.orderBy("h", "v").select("v").limit(k).collect()]
    centroids = np.array(starts, np.int64).reshape(-1, dims)
    if not len(centroids):  # only rows without ids, or none
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(sums(index, centroids), centroids)
    found = persist(assigned(index, centroids), "ball-assigned")
    inertias = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    held = lambda x: min(x, 2**63 - 1)
    digests = [(c, held(inertias.get(c, 0)), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    known = F.broadcast(spark.createDataFrame(digests, "cluster int, cluster_inertia long, centroid_sha256 string"))  # k rows
    return found.join(known, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(held(sum(inertias.values()))).cast("long").alias("inertia"), "centroid_sha256")


def oracle_sql(k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, seed: int = 2) -> str:
    nearest = """SELECT i, vec_id, v, c, d FROM (
      SELECT v.i, v.vec_id, v.v, c.c, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
      FROM v CROSS JOIN c{n} AS c) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c) = 1"""
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({nearest.format(n=n)})")
        steps.append(f"""s{n} AS (
      SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY p) AS v FROM (
        SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {dims + 1})) AS p FROM a{n}) GROUP BY c, p) GROUP BY c)""")
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(s{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN s{n} ON c{n}.c = s{n}.c)")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS INTEGER) AS c, v
  FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k}
), {", ".join(steps)}, z AS MATERIALIZED ({nearest.format(n=rounds)})
SELECT z.vec_id, z.c AS cluster, z.d AS distance, CAST(sum(z.d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(z.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM z JOIN c{rounds} AS f ON z.c = f.c
"""


ORACLE_SQL = oracle_sql()
