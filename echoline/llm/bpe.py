"""Byte-level BPE encoding and decoding.

Each pre-token is merged on a segment tree: the leaves are byte positions, a leaf's value is the rank of the pair
that starts there, and the root names the leftmost pair of minimum rank. A merge kills one leaf and updates the two
live neighbours on their way to the root. Pre-tokens of like length form one matrix of trees and are merged in
lockstep; longer ones have a tree of their own. Words met before come from a bounded cache.

Defined results: a null or empty text has no tokens; invalid UTF-8 bytes are replaced when decoded for splitting, as a
Python string would be; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame

from echoline.llm.base import binary_text

NO_RANK = np.int64(1) << 40
#: Pre-tokens up to this many bytes share a matrix of trees.
LOCKSTEP_BYTES = 64
#: Words that a worker remembers; the cache starts anew beyond it.
CACHE_WORDS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merger:
    """Ranks as two sorted arrays: (left id, right id) -> id of the merged token, whose rank it is."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[t[:k]] << 24) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NO_RANK)
        key = (left << 24) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        by_width: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if (whole := self.ids.get(w)) is not None:
                out[k] = [whole]
            elif len(w) > LOCKSTEP_BYTES:
                out[k] = self.encode_long(w)
            elif w:
                by_width.setdefault(1 << (len(w) - 1).bit_length(), []).append(k)
        for width, at in by_width.items():
            for start in range(0, len(at), 20_000):
                part = at[start : start + 20_000]
                for k, ids in zip(part, self.lockstep([words[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def lockstep(self, words: list[bytes], width: int) -> list[list[int]]:
        """One segment tree a row. A node holds rank * width + position of the least pair below it, the root at 1."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        token = self.first[raw]
        place = np.arange(width)
        after = np.broadcast_to(place + 1, (n, width)).copy()  # the next live position; lengths[row] ends the row
        before = np.broadcast_to(place - 1, (n, width)).copy()
        rank = np.full((n, width), NO_RANK)
        if width > 1:
            inside = place[None, :-1] + 1 < lengths[:, None]
            r, c = np.nonzero(inside)
            rank[r, c] = self.pair_ranks(token[r, c], token[r, c + 1])
        tree = np.empty((n, 2 * width), np.int64)
        tree[:, width:] = rank * width + place
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        top = 1 if width > 1 else width
        live = np.ones((n, width), bool) & (place < lengths[:, None])
        rows = np.arange(n)

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = value * width + at
            for _ in range(width.bit_length() - 1):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while True:
            rows = rows[tree[rows, top] < NO_RANK * width]
            if not len(rows):
                break
            least = tree[rows, top]
            at, merged = least % width, least // width
            gone = after[rows, at]
            follow = after[rows, gone]
            token[rows, at] = merged
            live[rows, gone] = False
            after[rows, at] = follow
            put(rows, gone, np.full(len(rows), NO_RANK))
            has = follow < lengths[rows]
            value = np.full(len(rows), NO_RANK)
            value[has] = self.pair_ranks(merged[has], token[rows[has], follow[has]])
            before[rows[has], follow[has]] = at[has]
            put(rows, at, value)
            prior = before[rows, at]
            has = prior >= 0
            put(rows[has], prior[has], self.pair_ranks(token[rows[has], prior[has]], merged[has]))
        return [t[m].tolist() for t, m in zip(token, live, strict=True)]

    def encode_long(self, word: bytes) -> list[int]:
        """The same tree for one long word, on plain lists."""
        n, pairs, none = len(word), self.pairs, int(NO_RANK)
        width = 1 << (n - 1).bit_length()
        token = [int(self.first[b]) for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [(none, k) for k in range(2 * width)]
        for k in range(n - 1):
            tree[width + k] = (pairs.get((token[k] << 24) | token[k + 1], none), k)
        for k in range(n - 1, width):
            tree[width + k] = (none, k)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, rank: int) -> None:
            node = at + width
            tree[node] = (rank, at)
            node >>= 1
            while node:
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best
                node >>= 1

        while tree[1][0] < none:
            merged, at = tree[1]
            gone = after[at]
            follow = after[at] = after[gone]
            token[at], token[gone] = merged, -1
            put(gone, none)
            if follow < n:
                before[follow] = at
            put(at, pairs.get((merged << 24) | token[follow], none) if follow < n else none)
            if (prior := before[at]) >= 0:
                put(prior, pairs.get((token[prior] << 24) | merged, none))
        return [t for t in token if t >= 0]


class Codec:
    """Encoder and decoder of whole texts; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merger = Merger(ranks)
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.bytes_of = [self.merger.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]

    def learn(self, words: Iterable[str]) -> None:
        new = list(set(words) - self.cache.keys())
        if not new:
            return
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(set(words))
        for w, ids in zip(new, self.merger.encode_words([w.encode("utf-8") for w in new]), strict=True):
            self.cache[w] = np.array(ids, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Several texts at once, so that new words are merged together."""
        split = [self.split(t) for t in texts]
        self.learn([w for words in split for w in words])
        return [b"".join(map(self.cache.__getitem__, words)) for words in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Bytes of text that are split at a time; bounds what a worker holds.
STEP_BYTES = 1 << 20


def encoded(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, ids, decoded) of each text, or the digests of both.

    The rank file is read on the driver and broadcast: a vocabulary has a fixed size, whatever the corpus.
    """
    import pyarrow as pa

    from echoline.llm.base import bound_batches, spark_to_arrow

    spark = df.sparkSession
    bound_batches(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" if digest else "id long, ids binary, decoded binary"
    fields = spark_to_arrow(spark, schema)

    def run(batches):
        codec = Codec(ranks.value, pattern)
        for batch in batches:
            docs, texts = (c.to_pylist() for c in batch.columns)
            raw = [(t or b"").decode("utf-8", "replace") for t in texts]
            at = 0
            while at < len(raw):
                stop, room = at, STEP_BYTES
                while stop < len(raw) and (room > 0 or stop == at):
                    room -= len(raw[stop])
                    stop += 1
                done = {}
                distinct = list(dict.fromkeys(raw[at:stop]))  # copies of a document stand side by side
                for text, ids in zip(distinct, codec.encode_many(distinct), strict=True):
                    back = codec.decode(ids)
                    done[text] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), len(back)) if digest else (ids, back)
                rows = [(doc, *done[text]) for doc, text in zip(docs[at:stop], raw[at:stop], strict=True)]
                at = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return binary_text(df, id_col, text_col).mapInArrow(run, schema)
