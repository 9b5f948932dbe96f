"""Words, window hashes, and the exchange that counts window hashes over the whole corpus.

Texts are read as bytes in numpy: word hashes come from prefix sums of a polynomial, window hashes from the hashes of their words.
Documents are dealt into chunks of a few MB by a hash of id and text. Each chunk sends every hash that it has once, packed by
bucket; the buckets add up the documents and answer, to the chunks concerned, only what a chunk can't know by itself.
Rows of the exchange never outnumber the hashes, buckets and chunks grow with the input, and a hash that every document
has arrives once a chunk, not once a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.base import bound_batches, spark_to_arrow, text_volume

CHUNK_BYTES, BUCKET_BYTES, PIECE = 3 << 20, 2 << 20, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD6E8FEB86659FD93)
NO_ID = np.int64(2**63 - 1)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit depends on all."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2**64, for i up to n at least."""
    size = max(PIECE, 1 << max(0, n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[size] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, inverse))
    return _powers[size]


def word_hashes(raw: np.ndarray, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word in raw, which ends with a separator. Long inputs go piece by piece."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        stop = min(len(raw), at + PIECE)
        while stop < len(raw):
            gaps = np.flatnonzero(SEPARATOR[raw[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                break
            stop = min(len(raw), stop + PIECE)
        piece = raw[at:stop]
        gap = SEPARATOR[piece]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        begin, end = edge[0::2], edge[1::2]
        power, inverse = powers(len(piece))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((fold[piece].astype(np.uint64) + np.uint64(1)) * power[: len(piece)], dtype=np.uint64)])
        h = (total[end] - total[begin]) * inverse[begin]
        starts.append(begin + at)
        hashes.append(mix(h ^ ((end - begin).astype(np.uint64) * STEP)))
        at = stop
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


class Texts:
    """The words of several texts: hash and owner (index of the text) of each, and where each text's words begin."""

    def __init__(self, texts: Iterable[bytes | None], fold: np.ndarray = SAME):
        texts = [t or b"" for t in texts]
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        start, self.hash = word_hashes(raw, fold)
        self.owner = np.searchsorted(ends, start, "right").astype(np.int32)
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.n = len(texts)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each window of width words inside one text."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = h * BASE + self.hash[k : k + n]
        at = np.flatnonzero(self.owner[:n] == self.owner[width - 1 :])
        return at, mix(h[at])


def deal(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """bucket << 32 | 32 low bits. A bucket holds about BUCKET_BYTES / 8 hashes at any size, so one hash in some
    16,000 shares its code with another; whoever needs exact matches compares 64 bits afterwards."""
    return (((h >> np.uint64(32)) * np.uint64(n_buckets)) & ~np.uint64(0xFFFFFFFF)) | (h & np.uint64(0xFFFFFFFF))


def distinct_counts(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes in order, texts that have each). Owners are in order."""
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    if not len(code):
        return code, np.empty(0, np.int64)
    new = np.concatenate([[True], code[1:] != code[:-1]])
    fresh = new | np.concatenate([[True], owner[1:] != owner[:-1]])
    at = np.flatnonzero(new)
    return code[at], np.add.reduceat(fresh.astype(np.int64), at)


def sizes(docs: DataFrame, text_col: str) -> tuple[int, int, int]:
    """(rows, chunks, buckets) for this input."""
    n, volume = text_volume(docs, text_col)
    return n, max(1, -(-volume // CHUNK_BYTES)), max(1, -(-volume // BUCKET_BYTES))


def chunked(docs: DataFrame, n_chunks: int, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(id, text, chunk[, rest]): documents dealt into chunks by a hash of the id and the text, once for all passes; rows
    without an id, or many of one id, spread as far as their texts differ."""
    rows = docs.select(
        docs[id_col].cast("long").alias("id"),
        docs[text_col].cast("binary").alias("text"),
        F.pmod(F.xxhash64(docs[id_col].cast("long"), docs[text_col]), F.lit(n_chunks)).cast("int").alias("chunk"),
        *([F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("rest")] if carry else []),
    )
    parts = max(1, min(n_chunks, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_chunks // 4)))
    return rows.repartition(parts, "chunk")


SENT = "bucket int, chunk int, keys binary, multi binary"
ANSWER = "chunk int, bucket int, keys binary, df binary"


def pack_counts(chunk: int, code: np.ndarray, count: np.ndarray, fields: pa.Schema) -> pa.Table:
    """A row for each bucket that the codes (in order) fall into: its 32-bit keys, and place and number of those with
    more than one text. The cost depends on the codes alone, however many buckets there are."""
    bucket = code >> np.uint64(32)
    edge = np.append(np.flatnonzero(np.diff(bucket, prepend=~bucket[:1])), len(code)).tolist()
    rows = []
    for low, high in zip(edge[:-1], edge[1:], strict=True):
        c, n = code[low:high], count[low:high]
        several = np.flatnonzero(n > 1)
        rows.append((int(bucket[low]), chunk, (c & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), np.stack([several, n[several]], 1).astype("<u4").tobytes()))
    return as_table(rows, fields)


def as_table(rows: list[tuple], fields: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, fields, strict=True)], schema=fields)


def repeated(chunks: DataFrame, codes: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """ANSWER rows: for each chunk, the keys that texts of other chunks have too, and how many texts have them in all.

    codes(table of a chunk) gives (code, owner) of each hash, owners in order.
    """
    spark = chunks.sparkSession
    bound_batches(spark)
    sent_fields, answer_fields = spark_to_arrow(spark, SENT), spark_to_arrow(spark, ANSWER)

    def send(chunk_table: pa.Table) -> pa.Table:
        chunk = chunk_table.column("chunk")[0].as_py()
        return pack_counts(chunk, *distinct_counts(*codes(chunk_table)), sent_fields)

    def count(bucket_table: pa.Table) -> pa.Table:
        bucket = bucket_table.column("bucket")[0].as_py()
        chunk, keys, multi = bucket_table.column("chunk").to_pylist(), bucket_table.column("keys"), bucket_table.column("multi")
        parts = [np.frombuffer(k.as_py(), "<u4") for k in keys]
        own = [np.ones(len(p), np.uint32) for p in parts]
        for n, m in zip(own, multi, strict=True):
            several = np.frombuffer(m.as_py(), "<u4").reshape(-1, 2)
            n[several[:, 0]] = several[:, 1]
        key, mine = np.concatenate(parts), np.concatenate(own)
        row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        order = np.argsort(key, kind="stable")
        key, mine, row = key[order], mine[order], row[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        total = np.add.reduceat(mine.astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        keep = total > mine
        key, total, row = key[keep], total[keep], row[keep]
        order = np.argsort(row, kind="stable")
        key, total, row = key[order], total[order], row[order]
        cut = np.searchsorted(row, np.arange(len(parts) + 1))
        return as_table([(chunk[r], bucket, key[cut[r] : cut[r + 1]].tobytes(), total[cut[r] : cut[r + 1]].astype("<u4").tobytes()) for r in np.flatnonzero(np.diff(cut)).tolist()], answer_fields)

    return chunks.groupBy("chunk").applyInArrow(send, SENT).groupBy("bucket").applyInArrow(count, ANSWER)


def answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(codes in order, texts in all) from a chunk's ANSWER rows."""
    code, total = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for bucket, keys, df in zip(*(table.column(c).to_pylist() for c in ("bucket", "keys", "df")), strict=True):
        code.append((np.uint64(bucket) << np.uint64(32)) | np.frombuffer(keys, "<u4").astype(np.uint64))
        total.append(np.frombuffer(df, "<u4").astype(np.int64))
    code, total = np.concatenate(code), np.concatenate(total)
    order = np.argsort(code, kind="stable")
    return code[order], total[order]


def look_up(code: np.ndarray, known: np.ndarray, value: np.ndarray, default) -> np.ndarray:
    """value[where known == code], default elsewhere; known is in order."""
    if not len(known):
        return np.full(len(code), default, value.dtype)
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    return np.where(known[at] == code, value[at], value.dtype.type(default))
