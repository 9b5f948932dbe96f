"""Substring dedup by difference-cover anchors.

Windows of ANCHOR words are hashed only at word positions whose remainder modulo PERIOD lies in COVER, a difference cover:
for any two positions there is a shift below PERIOD that puts both into it. So two equal runs of PERIOD - 1 + ANCHOR
words, wherever they stand, share an anchor at the same offset. Anchors that more than one document has are found with
the corpus-wide exchange; only windows of WINDOW words around such an anchor are extended to full 64-bit hashes (plus
the bucket's bits), and the smallest document of each is found with a second exchange. A word is removed if it is covered by a window that
also starts in a document with a smaller id; windows are judged on the input.

Defined results: a null or empty text has no words; a text shorter than the window loses nothing; rows without an id
count as the largest id; rows of one id are one document to one another; repeats inside one document stay.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.base import bound_batches, spark_to_arrow
from echoline.llm.shingles import NO_ID, Texts, answers, as_table, chunked, deal, distinct_counts, look_up, repeated, sizes

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1

OFFERS = "bucket int, chunk int, keys binary, ids binary"
OWNERS = "chunk int, bucket int, keys binary, ids binary"
RESULT = "id long, n_words long, n_removed long, kept_sha256 string"


def in_order(table: pa.Table) -> tuple[np.ndarray, list[bytes | None], np.ndarray]:
    """(ids, texts, row of each) by ascending id."""
    ids = np.array([NO_ID if i is None else i for i in table.column("id").to_pylist()], np.int64)
    order = np.argsort(ids, kind="stable")
    texts = table.column("text").to_pylist()
    return ids[order], [texts[k] for k in order], order


def anchors(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of the windows at cover positions, counted from each text's first word."""
    at, h = texts.windows(ANCHOR)
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True
    keep = covered[(at - texts.first[texts.owner[at]]) % PERIOD]
    return at[keep], h[keep]


def near_shared_anchor(texts: Texts, at: np.ndarray, anchor_at: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which of the windows that start at the words `at` hold a shared anchor."""
    count = np.zeros(len(texts.hash) + 2, np.int64)
    count[anchor_at[shared] + 1] = 1
    total = np.cumsum(count)
    return total[at + WINDOW - ANCHOR + 1] > total[at]


def first_owner(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, smallest owner of each, group of each input). Owners are in order."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if len(key) else np.empty(0, bool)
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(new) - 1
    return sorted_key[new], owner[order][new], group


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """RESULT for each row; with carry also `text`, the kept words (texts that lose nothing stay as they are), and `rest`, the other columns."""
    spark = docs.sparkSession
    bound_batches(spark)
    _, n_chunks, n_buckets = sizes(docs, text_col)
    chunks = chunked(docs, n_chunks, id_col, text_col, carry)
    schema = RESULT + (f", text binary, rest {chunks.schema['rest'].dataType.simpleString()}" if carry else "")
    offer_fields, owner_fields, result_fields = (spark_to_arrow(spark, s) for s in (OFFERS, OWNERS, RESULT))

    def anchor_codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, bodies, _ = in_order(table)
        texts = Texts(bodies)
        at, h = anchors(texts)
        return deal(h, n_buckets), np.searchsorted(np.unique(ids), ids)[texts.owner[at]]

    def offer(table: pa.Table, known: pa.Table) -> pa.Table:
        """The windows around anchors that several documents have, once each, with this chunk's smallest id."""
        if not table.num_rows:
            return as_table([], offer_fields)
        chunk = table.column("chunk")[0].as_py()
        ids, bodies, _ = in_order(table)
        texts = Texts(bodies)
        anchor_at, h = anchors(texts)
        code = deal(h, n_buckets)
        local, n_texts = distinct_counts(code, np.searchsorted(np.unique(ids), ids)[texts.owner[anchor_at]])
        elsewhere, total = answers(known)
        shared = (look_up(code, local, n_texts, 0) > 1) | (look_up(code, elsewhere, total, 0) > 1)
        at, key = texts.windows(WINDOW)
        near = near_shared_anchor(texts, at, anchor_at, shared)
        key, owner, _ = first_owner(key[near], texts.owner[at[near]])
        bucket = key_bucket(key, n_buckets)
        order = np.argsort(bucket, kind="stable")
        key, owner, bucket = key[order], owner[order], bucket[order]
        edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
        return as_table([(int(bucket[low]), chunk, key[low:high].tobytes(), ids[owner[low:high]].tobytes()) for low, high in zip(edge[:-1], edge[1:], strict=True)], offer_fields)

    def settle(table: pa.Table) -> pa.Table:
        """The smallest id of each window over all chunks, to the chunks whose own is larger."""
        bucket, chunk = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        keys = [np.frombuffer(k.as_py(), np.uint64) for k in table.column("keys")]
        key, own = np.concatenate(keys), np.concatenate([np.frombuffer(i.as_py(), np.int64) for i in table.column("ids")])
        row = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
        order = np.lexsort((own, key))
        key, own, row = key[order], own[order], row[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        least = own[new][np.cumsum(new) - 1]
        keep = least < own
        key, least, row = key[keep], least[keep], row[keep]
        order = np.argsort(row, kind="stable")
        key, least, row = key[order], least[order], row[order]
        edge = np.searchsorted(row, np.arange(len(keys) + 1))
        return as_table([(chunk[r], bucket, key[edge[r] : edge[r + 1]].tobytes(), least[edge[r] : edge[r + 1]].tobytes()) for r in np.flatnonzero(np.diff(edge)).tolist()], owner_fields)

    def finish(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            empty = as_table([], result_fields)
            return empty if not carry else pa.Table.from_arrays([*empty.columns, pa.array([], pa.binary()), table.column("rest").combine_chunks()], names=[*result_fields.names, "text", "rest"])
        ids, bodies, order = in_order(table)
        texts = Texts(bodies)
        at, key = texts.windows(WINDOW)
        distinct, owner, group = first_owner(key, texts.owner[at])
        k = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in known.column("keys"))])
        i = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x.as_py(), np.int64) for x in known.column("ids"))])
        by_key = np.argsort(k, kind="stable")
        least = np.minimum(ids[owner], look_up(distinct, k[by_key], i[by_key], NO_ID))
        gone = at[least[group] < ids[texts.owner[at]]]
        step = np.zeros(len(texts.hash) + 1, np.int64)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + WINDOW, -1)
        kept = np.cumsum(step)[:-1] == 0
        rows, new_texts = [], []
        for d, body in enumerate(bodies):
            mask = kept[texts.first[d] : texts.first[d + 1]]
            words = (body or b"").split()
            n = int(mask.sum())
            rest = b" ".join(words if n == len(words) else compress(words, mask.tolist()))
            rows.append((None if ids[d] == NO_ID else int(ids[d]), len(words), len(words) - n, hashlib.sha256(rest).hexdigest()))
            new_texts.append(body if n == len(words) else rest)
        out = as_table(rows, result_fields)
        if carry:
            out = out.append_column("text", pa.array(new_texts, pa.binary())).append_column("rest", table.column("rest").take(pa.array(order)))
        return out

    shared = repeated(chunks, anchor_codes)
    offers = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(offer, OFFERS)
    owners = offers.groupBy("bucket").applyInArrow(settle, OWNERS)
    return chunks.groupBy("chunk").cogroup(owners.groupBy("chunk")).applyInArrow(finish, schema)


def key_bucket(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def substring_query(docs: DataFrame) -> DataFrame:
    return cut(docs).withColumnRenamed("id", "doc_id")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated words taken out of the text; every row and column stays."""
    done = cut(docs, id_col, text_col, carry=True)
    return done.select(*[F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, unnest(generate_series(1, len(words) - 12)) AS i, words FROM w WHERE len(words) >= 13
), h AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM p
), g AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM h
), c AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS k FROM g WHERE least < doc_id
), r AS (
  SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""
