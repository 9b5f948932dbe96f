"""Target-distribution importance resampling: draw the documents whose word n-grams look most like a target's.

Features are runs of one to three words, hashed into buckets. The two bucket histograms (of all documents, of all target
texts) give each bucket an integer gain; a document's weight is the sum of the gains of its features, taken from arrays.
Adding Gumbel noise from a hash of the id turns the highest scores into a draw without replacement.

The draw: every task sorts its eligible rows into runs and cuts them where ranges of the order begin; ranges are given
by splitters from a bounded hash sample, which only decide how work is dealt out. Exact counts of the ranges give
each its first rank and tell where the draw ends. A range's blocks come in the order of their first rows, from disk, and
a tournament tree over the blocks that are open merges them; it stops as soon as the exact number is drawn.

The n-gram hashes are crc32 of whole strings, put together from crc32 of their words: a crc is linear, so appending n
bytes to a string is a table lookup a byte of its crc.

Defined results: null, empty and wordless texts have no features and weight 0; bytes that are not valid UTF-8 count as
letters, as they are; a row without an id has a weight, but no score, and is never drawn nor counted among those that
may be; rows that repeat an id and a text all count, and those of one score and id are ranked in any order; an empty target or table gives
gains by the same formula; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.base import binary_text, bound_batches, persist, spark_to_arrow

BUCKETS, LONGEST_RUN, SHARE, LEAST_WORDS, SEED = 10_000, 3, (5, 100), 20, 42
#: Bytes of text whose words are hashed at a time, lengths that have a table of their own.
STEP, TABLE_BYTES = 1 << 20, 48
#: Rows of a sorted run and of a block at most; rows that a range should have, ranges at most and sampled rows for each.
RUN_ROWS, BLOCK_ROWS, RANGE_ROWS, MOST_RANGES, SAMPLED = 1 << 18, 1024, 1 << 14, 4096, 64
SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean"
BLOCKS = "part int, score long, doc_id long, at long, n int, scores array<long>, ids array<long>, ats array<long>, features array<long>, weights array<long>"
DRAWN = "doc_id long, n_features long, weight long, score long, at long, rank long"

#: Words are what is left when every ASCII byte but digits and letters parts them; upper case goes.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tables() -> np.ndarray:
    """[bytes appended, place of a byte, byte] -> what that byte of a crc becomes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    out = np.empty((TABLE_BYTES + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(TABLE_BYTES):
        out[n + 1] = one[out[n] & 255] ^ (out[n] >> 8)
    return out.reshape(TABLE_BYTES + 1, 1024)


class Hasher:
    def __init__(self) -> None:
        self.table = tables()

    def appended(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """crc of strings that grow by n zero bytes each, without the first and last complement."""
        flat, out, left = self.table.ravel(), crc, n
        while True:
            at = np.minimum(left, TABLE_BYTES) * 1024
            out = flat[at + (out & 255)] ^ flat[at + 256 + (out >> 8 & 255)] ^ flat[at + 512 + (out >> 16 & 255)] ^ flat[at + 768 + (out >> 24)]
            left = np.maximum(left - TABLE_BYTES, 0)
            if not left.any():
                return out

    def joined(self, words: list[bytes]) -> list[np.ndarray]:
        """crc32 of all runs of 1, 2, 3 words, each by its first word."""
        crc, n = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), np.fromiter(map(len, words), np.int64, len(words))
        out, space = [crc], np.uint32(zlib.crc32(b" "))
        for _ in range(LONGEST_RUN - 1):
            head = out[-1][:-1]
            spaced = self.appended(head, np.ones(len(head), np.int64)) ^ space
            tail = len(out)
            out.append(self.appended(spaced, n[tail:]) ^ crc[tail:])
        return out

    def features(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(new words, buckets of the features that end in them) of the text's successive steps."""
        held: list[bytes] = []
        at = 0
        while at < len(text):
            stop = at + STEP
            while stop < len(text) and WORDS[text[stop]] != 32:
                stop += 1
            new = text[at:stop].translate(WORDS).split()
            at = stop
            if not new:
                continue
            words, old = held + new, len(held)
            found = [c[max(0, old - k) :] for k, c in enumerate(self.joined(words))]  # those that end in a new word
            yield len(new), np.concatenate(found) % np.uint32(BUCKETS)
            held = words[-(LONGEST_RUN - 1) :]


def histogram(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features in each bucket, over all texts; a row for each task and bucket is shuffled."""
    bound_batches(df.sparkSession)
    schema = "bucket int, n long"
    fields = spark_to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, n = Hasher(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, buckets in hasher.features(text or b""):
                    n += np.bincount(buckets, minlength=BUCKETS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used])], schema=fields)

    out = np.zeros(BUCKETS, np.int64)
    for r in df.select(df[text_col].cast("binary").alias("text")).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How much likelier each bucket is in the target, in thousandths of a nat."""
    s_all, t_all = float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in zip(raw.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def noise(doc: int, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    bound_batches(df.sparkSession)
    fields = spark_to_arrow(df.sparkSession, SCORED)
    sent = df.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, gain = Hasher(), sent.value
        for batch in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = n = weight = 0
                for new, buckets in hasher.features(text or b""):
                    words, n, weight = words + new, n + len(buckets), weight + int(gain[buckets].sum())
                rows.append((doc, n, weight, None if doc is None else weight + noise(doc, seed), doc is not None and words >= least_words))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return binary_text(df, id_col, text_col).mapInArrow(run, SCORED)


class Tournament:
    """A tree whose leaves are sorted cursors and whose inner nodes name the winner below; keys are tuples, the least wins."""

    def __init__(self) -> None:
        self.width, self.keys, self.free = 1, [None], [0]
        self.tree = [-1, -1]

    def better(self, a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        return a if self.keys[a] <= self.keys[b] else b

    def put(self, leaf: int, key: tuple | None) -> None:
        """A cursor's new first key, or None where it has run out; its matches are played again up to the root."""
        self.keys[leaf] = key
        node = leaf + self.width
        self.tree[node] = -1 if key is None else leaf
        while node > 1:
            node >>= 1
            self.tree[node] = self.better(self.tree[2 * node], self.tree[2 * node + 1])

    def enter(self, key: tuple) -> int:
        if not self.free:
            entered = [k for k in self.keys]
            self.free = list(range(2 * self.width - 1, self.width - 1, -1))
            self.width *= 2
            self.keys = entered + [None] * (self.width // 2)
            self.tree = [-1] * self.width + [k if v is not None else -1 for k, v in enumerate(self.keys)]
            for node in range(self.width - 1, 0, -1):
                self.tree[node] = self.better(self.tree[2 * node], self.tree[2 * node + 1])
        leaf = self.free.pop()
        self.put(leaf, key)
        return leaf

    def leave(self, leaf: int) -> None:
        self.put(leaf, None)
        self.free.append(leaf)

    @property
    def winner(self) -> int:
        return self.tree[1]


def merged(blocks: Iterable[tuple[tuple, Any]], row: Any, most: int) -> Iterator[tuple]:
    """The first `most` rows of sorted blocks that come as (first key, block) in the order of their first keys.

    row(block, k) is its kth row, which starts with its key, or None behind its end. Only blocks whose turn has come are open.
    """
    tree, cursors = Tournament(), {}
    waiting = iter(blocks)
    coming = next(waiting, None)
    drawn = 0
    while drawn < most:
        while coming is not None and (tree.winner < 0 or coming[0] <= tree.keys[tree.winner]):
            cursors[tree.enter(coming[0])] = [coming[1], 0]
            coming = next(waiting, None)
        leaf = tree.winner
        if leaf < 0:
            return
        cursor = cursors[leaf]
        yield row(*cursor)
        drawn += 1
        cursor[1] += 1
        following = row(*cursor)
        if following is None:
            tree.leave(leaf)
            del cursors[leaf]
        else:
            tree.put(leaf, following[0])


def order(score: int, doc: int, at: int) -> tuple[int, int, int]:
    return -score, doc, at


def blocks(rows: DataFrame, splitters: list[tuple[int, int, int]]) -> DataFrame:
    """Sorted runs of the eligible rows, cut where ranges begin and into blocks."""
    fields = spark_to_arrow(rows.sparkSession, BLOCKS)
    sent = rows.sparkSession.sparkContext.broadcast(splitters)  # fewer than MOST_RANGES

    def cut(score: np.ndarray, doc: np.ndarray, at: np.ndarray, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        ordered = np.lexsort((at, doc, -score))
        columns = [c[ordered] for c in (score, doc, at, *rest)]
        edges, low = [0], 0
        for s, d, a in sent.value:  # the first place that is not before the splitter
            high = len(ordered)
            while low < high:
                middle = (low + high) // 2
                if order(int(columns[0][middle]), int(columns[1][middle]), int(columns[2][middle])) < (s, d, a):
                    low = middle + 1
                else:
                    high = middle
            edges.append(low)
        edges.append(len(ordered))
        found = []
        for part, (start, stop) in enumerate(zip(edges, edges[1:], strict=False)):
            for k in range(start, stop, BLOCK_ROWS):
                piece = [c[k : min(k + BLOCK_ROWS, stop)] for c in columns]
                found.append((part, int(piece[0][0]), int(piece[1][0]), int(piece[2][0]), len(piece[0]), *piece))
        for k in range(0, len(found), 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found[k : k + 16], strict=True), fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) >= RUN_ROWS:
                yield from cut(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
        if sum(len(h[0]) for h in held):
            yield from cut(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return rows.select("score", "doc_id", "at", "n_features", "weight").mapInArrow(run, BLOCKS)


def ranked(found: DataFrame, starts: dict[int, tuple[int, int]], parts: int) -> DataFrame:
    """Ranks of all rows to draw. starts: each range's rows before it and rows to draw."""
    fields = spark_to_arrow(found.sparkSession, DRAWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield tuple(batch.column(c)[k] for c in range(batch.num_columns))

        stream = rows()
        coming = next(stream, None)

        def of(part: int) -> Iterator[tuple[tuple, list]]:
            nonlocal coming
            while coming is not None and coming[0].as_py() == part:
                yield order(*(coming[k].as_py() for k in (1, 2, 3))), [c.values.to_numpy().tolist() for c in coming[5:]]
                coming = next(stream, None)

        def row(block: list, k: int) -> tuple | None:
            return (order(block[0][k], block[1][k], block[2][k]), block, k) if k < len(block[0]) else None

        out: list[tuple] = []
        while coming is not None:
            part = coming[0].as_py()
            before, most = starts[part]
            mine = of(part)
            for rank, (_, block, k) in enumerate(merged(mine, row, most), before + 1):
                out.append((block[1][k], block[3][k], block[4][k], block[0][k], block[2][k], rank))
                if len(out) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
                    out = []
            for _ in mine:  # the rest of a range in which the draw ends
                pass
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    dealt = found.where(F.col("part") <= max(starts)).repartition(parts, "part").sortWithinPartitions("part", F.desc("score"), "doc_id", "at")
    return dealt.mapInArrow(run, DRAWN)


def drawn(rows: DataFrame, n: int, eligible: int) -> DataFrame:
    """(doc_id, n_features, weight, score, at, rank) of the n highest scores of the eligible rows; at tells rows apart."""
    spark = rows.sparkSession
    able = rows.where("eligible")
    ranges = min(MOST_RANGES, -(-eligible // RANGE_ROWS))
    splitters: list[tuple[int, int, int]] = []
    if ranges > 1:
        every = max(1, eligible // (ranges * SAMPLED))
        sample = sorted(order(*r) for r in able.where(F.pmod(F.xxhash64("doc_id", "at"), F.lit(every)) == 0).select("score", "doc_id", "at").collect())
        splitters = sample[SAMPLED :: max(1, len(sample) // ranges)][: ranges - 1]
    found = persist(blocks(able, splitters), "resampling-runs")
    counts = sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, before = {}, 0
    for part, size in counts:
        if before < n:
            starts[part] = before, min(size, n - before)
            before += size
    return ranked(found, starts, max(len(starts), 1)) if starts else spark.createDataFrame([], DRAWN)


def resample(df: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null where it isn't drawn."""
    gain = gains(histogram(df, text_col), histogram(target, target_col))
    rows = persist(scored(df, gain, id_col, text_col, least_words, seed).withColumn("at", F.monotonically_increasing_id()), "resampling-scored")
    eligible = rows.where("eligible").count()
    n = share[0] * eligible // share[1]
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    if not n:
        return rest
    chosen = persist(drawn(rows, n, eligible), "resampling-drawn")
    last = chosen.where(F.col("rank") == n).select("score", "doc_id", "at").first()
    behind = (F.col("score") < last["score"]) | (F.col("score") == last["score"]) & ((F.col("doc_id") > last["doc_id"]) | (F.col("doc_id") == last["doc_id"]) & (F.col("at") > last["at"]))
    undrawn = rows.where(~F.col("eligible") | behind)
    return chosen.select(*columns, "rank").unionByName(undrawn.select(*columns, F.lit(None).cast("long").alias("rank")))


#: crc32 has no function in this SQL; its byte table follows from the polynomial, and a run of words goes on from the state
#: that the run without its last word has left.
ORACLE_SQL = """
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), texts AS MATERIALIZED (
  SELECT row_number() OVER () AS i, doc_id, text, true AS raw FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark
), words AS MATERIALIZED (
  SELECT i, p, w FROM (
    SELECT i, unnest(l) AS w, unnest(range(len(l))) AS p FROM (
      SELECT i, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS l FROM texts))
), vocabulary AS MATERIALIZED (
  SELECT w, list_transform(range(1, len(h) // 2 + 1), lambda k: CAST('0x' || substr(h, 2 * k - 1, 2) AS BIGINT)) AS b
  FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM words)
), one AS MATERIALIZED (
  SELECT w, b, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS INTEGER) + 1])) AS s FROM vocabulary, crc
), runs AS MATERIALIZED (
  SELECT i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY i ORDER BY p)
), two AS MATERIALIZED (
  SELECT p.w, p.w2, list_reduce(list_concat([a.s, CAST(32 AS BIGINT)], b.b), lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS INTEGER) + 1])) AS s
  FROM (SELECT DISTINCT w, w2 FROM runs WHERE w2 IS NOT NULL) AS p JOIN one AS a ON p.w = a.w JOIN one AS b ON p.w2 = b.w, crc
), three AS MATERIALIZED (
  SELECT p.w, p.w2, p.w3, list_reduce(list_concat([a.s, CAST(32 AS BIGINT)], b.b), lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS INTEGER) + 1])) AS s
  FROM (SELECT DISTINCT w, w2, w3 FROM runs WHERE w3 IS NOT NULL) AS p JOIN two AS a ON p.w = a.w AND p.w2 = a.w2 JOIN one AS b ON p.w3 = b.w, crc
), features AS MATERIALIZED (
  SELECT i, xor(s, 4294967295) % 10000 AS bucket FROM (
    SELECT i, s FROM runs JOIN one USING (w)
    UNION ALL SELECT i, s FROM runs JOIN two USING (w, w2)
    UNION ALL SELECT i, s FROM runs JOIN three USING (w, w2, w3))
), counted AS (
  SELECT bucket, count(*) FILTER (i > 0) AS s, count(*) FILTER (i < 0) AS t FROM features GROUP BY bucket
), gain AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS g FROM counted
), weighed AS (
  SELECT i, count(*) AS n, sum(g) AS weight FROM features JOIN gain USING (bucket) WHERE i > 0 GROUP BY i
), scored AS (
  SELECT x.i, x.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || CAST(x.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score,
    x.doc_id IS NOT NULL AND coalesce(l.n_words, 0) >= 20 AS eligible
  FROM texts AS x LEFT JOIN weighed USING (i) LEFT JOIN (SELECT i, count(*) AS n_words FROM words GROUP BY i) AS l USING (i) WHERE x.raw
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS r, sum(CAST(eligible AS INTEGER)) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND r <= 5 * able // 100 THEN r END AS rank FROM ranked
"""
