"""Exact top-k search by block-at-a-time pruning.

The index holds document-range blocks: documents are ordered by a coarse cell, cut into blocks of a fixed number, and
each block carries the maxima of its terms and a forward index. A term is a dimension with a sign, so a query's bound
on a block is the sum, over its dimensions, of its component times the block's largest (or, if negative, smallest)
component. Blocks are scored in the order of falling bounds until the bound falls below the query's kth score; a bound
equal to it is still scored, for ties go to the smaller id.

Queries come in chunks of a fixed number, which are broadcast one after another; each index partition gives its best k
of every query, and the last step keeps the best k of those.

Defined results: null vectors and vectors with null or non-finite components take no part; vectors are compared with
those of equal length only; repeated ids are separate candidates, but no row of the query's own id is its candidate; query rows
that repeat an id and its vector are one query, rows of one id with other vectors are ranked each for itself; an empty table gives no rows;
fewer than k candidates give fewer rows. Components are floor(scale * x) as 64-bit integers; a magnitude beyond 2**62
is clamped there before the product, and products are exact below 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoline.llm.base import bound_batches, persist, spark_to_arrow

BLOCK, QUERY_CHUNK, CELL_BITS = 128, 4096, 12
#: Integers below this give products that float64 adds without loss (for up to 256 dimensions).
EXACT = 1 << 22
INDEX = "dim int, n int, ids binary, forward binary, top binary, low binary"
FOUND = "query_id long, asked long, vec_id long, score long"


def integer_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<bigint>, cell): the rows that take part; the cell orders them for the blocks."""
    ok = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    signs = F.lit(0)
    for k in range(CELL_BITS):
        signs = signs * 2 + (F.coalesce(F.get("v", F.lit(k)), F.lit(0)) >= 0).cast("int")
    clamp = lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(2.0**62)), F.lit(-(2.0**62))))
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("x")).where(ok & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.transform("x", clamp).alias("v")).select("vec_id", "v", signs.alias("cell"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def blocks(vectors: DataFrame) -> DataFrame:
    """The index, a row for each block."""
    bound_batches(vectors.sparkSession)
    fields = spark_to_arrow(vectors.sparkSession, INDEX)

    def row(dim: int, ids: np.ndarray, m: np.ndarray) -> tuple:
        return dim, len(ids), ids.tobytes(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths, out = vectors.value_lengths().to_numpy(zero_copy_only=False), []
            for dim in np.unique(lengths):
                held = rest.setdefault(int(dim), [])
                held.append((ids[lengths == dim].astype(np.int64), matrix(vectors.filter(pa.array(lengths == dim)), int(dim))))
                if sum(len(i) for i, _ in held) >= BLOCK:
                    i, m = np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])
                    whole = len(i) // BLOCK * BLOCK
                    out += [row(int(dim), i[k : k + BLOCK], m[k : k + BLOCK]) for k in range(0, whole, BLOCK)]
                    rest[int(dim)] = [(i[whole:], m[whole:])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
        out = [row(dim, np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])) for dim, held in rest.items() if sum(len(i) for i, _ in held)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    ordered = vectors.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").select("vec_id", "v")
    return ordered.mapInArrow(run, INDEX)


def product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """q @ m.T without loss: by floats while all partial sums stay below 2**53, else by 64-bit integers."""
    if max(np.abs(q).max(initial=0), np.abs(m).max(initial=0)) < EXACT and q.shape[1] <= 256:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    return q @ m.T


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, -scores))[:k]
    return ids[keep], scores[keep]


def search_blocks(query_ids: np.ndarray, queries: np.ndarray, index: list[tuple], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, ids, scores, blocks scored) of one partition's blocks; all have the queries' number of dimensions."""
    top, low = np.stack([b[2] for b in index]), np.stack([b[3] for b in index])
    bounds = product(np.maximum(queries, 0), top) + product(np.minimum(queries, 0), low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    for row, (own, q) in enumerate(zip(query_ids, queries, strict=True)):
        ids, scores, done = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for at in range(0, len(index), 8):
            group = order[row, at : at + 8]
            if len(ids) >= k:
                group = group[bounds[row, group] >= scores[k - 1]]
            if not len(group):
                break
            i, m = np.concatenate([index[b][0] for b in group]), np.concatenate([index[b][1] for b in group])
            s = product(q[None, :], m)[0]
            keep = i != own
            if len(ids) >= k:
                keep &= s >= scores[k - 1]
            ids, scores = best_of(np.concatenate([ids, i[keep]]), np.concatenate([scores, s[keep]]), k)
            done += len(group)
        yield own, ids, scores, done


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = QUERY_CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all vectors."""
    spark = vectors.sparkSession
    index = persist(blocks(integer_vectors(vectors, scale, id_col, vector_col)), "topk-index")
    asked = persist(integer_vectors(queries, scale, id_col, vector_col).select("vec_id", "v").distinct().withColumn("asked", F.monotonically_increasing_id()), "topk-queries")
    fields = spark_to_arrow(spark, FOUND)
    found: DataFrame | None = None

    def scan(part: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(part)  # at most `chunk` vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_dim: dict[int, list[tuple]] = {}
            for batch in batches:
                for dim, n, ids, forward, top, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    by_dim.setdefault(dim, []).append((np.frombuffer(ids, np.int64), np.frombuffer(forward, np.int64).reshape(n, dim), np.frombuffer(top, np.int64), np.frombuffer(low, np.int64)))
            for dim, held in by_dim.items():
                mine = [q for q in sent.value if len(q[1]) == dim]
                for start in range(0, len(mine), 256):
                    some = mine[start : start + 256]
                    for (_, _, row), (own, ids, scores, _) in zip(some, search_blocks(np.array([i for i, *_ in some], np.int64), np.array([v for _, v, _ in some], np.int64), held, k), strict=True):
                        if len(ids):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), own)), pa.array(np.full(len(ids), row)), pa.array(ids), pa.array(scores)], schema=fields)

        return index.mapInArrow(run, FOUND)

    part: list = []
    for r in asked.toLocalIterator():
        part.append((r["vec_id"], r["v"], r["asked"]))
        if len(part) == chunk:
            done = persist(scan(part), "topk-found")
            found, part = done if found is None else found.unionByName(done), []
    if part or found is None:
        last = scan(part)
        found = last if found is None else found.unionByName(last)
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
