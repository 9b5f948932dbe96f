"""SentencePiece BPE encoding and decoding with byte spans of the source.

A model file is read as the protocol buffer that it is. Text is normalised from left to right by the longest prefix that
the compiled character map (a double array over bytes, followed by the replacements) holds; every byte of the normalised
text keeps the byte offset in the source of the prefix that it came from. Pieces are found in the normalised text and
projected through these offsets to spans of the source. Where no piece has a space mark after another character, runs
of marks start segments that never merge with what precedes them, and segments met before come from a bounded memory;
new ones of several texts are merged together, those of a length in lockstep.

Defined results: a null or empty text has no pieces and decodes to the empty text; invalid UTF-8 is replaced by U+FFFD before
anything else, as a Python string would be (spans then count bytes of that string); equal scores merge leftmost first;
unknown characters become their bytes where the model falls back to bytes, else one unknown piece for each run of them;
repeated rows give repeated rows; an empty table gives none. Models of other kinds than BPE are refused.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from echoline.llm.base import binary_text

MARK = "▁"
#: Kinds of pieces and of models in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
NO_RANK = 1 << 60
#: Characters that are normalised and segmented at a time, estimated bytes of each of the two generations of segments that a
#: worker remembers, the length from which a segment's pairs are kept in a heap, and from how many segments of a length on
#: these are merged in lockstep.
STEP, CACHE_BYTES, LONG, TOGETHER = 1 << 20, 110 << 20, 64, 16

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def proto(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """What encoding and decoding need of a model file."""

    def __init__(self, data: bytes):
        parts = list(proto(data))
        rows = [dict(proto(v)) for f, v in parts if f == 1]
        trainer, normaliser = ({k: v for f, part in parts if f == number for k, v in proto(part)} for number in (2, 3))
        if trainer.get(3, 1) != BPE:
            raise ValueError("only BPE models can be encoded with")
        self.pieces = [r[1].decode("utf-8") for r in rows]
        self.scores = [struct.unpack("<f", r[2])[0] if 2 in r else 0.0 for r in rows]
        self.kinds = [r.get(3, NORMAL) for r in rows]
        self.suffix, self.byte_fallback = bool(trainer.get(24, 0)), bool(trainer.get(35, 0))
        self.unknown_surface = trainer.get(44, " ⁇ ".encode()).decode("utf-8")
        self.charsmap = normaliser.get(2, b"")
        self.prefix, self.collapse, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        own = sorted((p for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER_DEFINED), key=len, reverse=True)
        self.user_defined = re.compile("|".join(map(re.escape, own))) if own else None


class CharacterMap:
    """Longest-prefix lookup in a compiled character map."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size :]
        self.step = functools.lru_cache(1 << 16)(self._step)

    @staticmethod
    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, node: int, char: str) -> tuple[int, int]:
        """(node, replacement or -1) behind one more character; node -1: no key goes on so."""
        value = -1
        for byte in char.encode("utf-8"):
            node ^= byte
            if node >= len(self.units) or self.units[node] & 0x800000FF != byte:
                return -1, -1
            leaf = self.units[node] & 256
            node ^= self.offset(self.units[node])
            value = self.units[node] & 0x7FFFFFFF if leaf else -1
        return node, value

    def longest(self, text: str, at: int) -> tuple[int, str | None]:
        """(characters, replacement) of the longest key that starts at a place; (1, None) if none does."""
        node, found, end = self.offset(self.units[0]), -1, at
        for k in range(at, len(text)):
            node, value = self.step(node, text[k])
            if node < 0:
                break
            if value >= 0:
                found, end = value, k + 1
        return (end - at, self.replacements[found : self.replacements.index(b"\0", found)].decode("utf-8")) if found >= 0 else (1, None)

    @functools.cached_property
    def holds_space_inside(self) -> bool:
        """Whether a key has a space behind its first character; then no place before a space is safe to cut at."""
        units, every = np.array(self.units, np.int64), np.arange(256)
        nodes, depth = np.array([self.offset(self.units[0])]), 0
        while len(nodes):
            to = nodes[:, None] ^ every
            row, byte = np.nonzero((to < len(units)) & (units[np.minimum(to, len(units) - 1)] & 0x800000FF == every))
            if depth and (byte == 32).any():
                return True
            to = to[row, byte]
            nodes, depth = to ^ ((units[to] >> 10) << ((units[to] & 512) >> 6)), depth + 1
        return False


class Normaliser:
    """Normalised text in chunks, each with the source's byte offset of every byte."""

    CUT = re.compile("(?<=[0-9A-Za-z]) ")

    def __init__(self, model: Model):
        self.m = model
        self.map = CharacterMap(model.charsmap) if model.charsmap else None
        self.space = MARK if model.escape else " "
        self.plain = self.map is None and model.user_defined is None and not model.collapse

    def cut(self, text: str) -> Iterator[str]:
        """Parts of about STEP characters; no key, run of spaces or segment spans a cut."""
        at = 0
        whole = self.map is not None and self.map.holds_space_inside or self.m.user_defined is not None
        while len(text) - at > STEP and not whole and (place := self.CUT.search(text, at + STEP)):
            yield text[at : place.start()]
            at = place.start()
        yield text[at:]

    def prefixes(self, text: str) -> Iterator[tuple[int, str]]:
        """(source bytes, replacement) of each longest prefix."""
        at, own = 0, self.m.user_defined
        while at < len(text):
            if own and (found := own.match(text, at)):
                n, put = found.end() - at, found.group()
            else:
                n, put = self.map.longest(text, at) if self.map else (1, None)
            source = text[at : at + n]
            yield len(source.encode("utf-8")), source if put is None else put
            at += n

    def chunks(self, text: str) -> Iterator[tuple[str, np.ndarray]]:
        m = self.m
        done, started, after_space = 0, False, m.collapse
        parts = list(self.cut(text)) if text else []
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if self.plain:
                raw = np.frombuffer(part.encode("utf-8"), np.uint8)
                out = [part.replace(" ", self.space)]
                offsets = np.repeat(np.arange(done, done + len(raw)), np.where(raw == 32, len(self.space.encode()), 1))
                done += len(raw)
            else:
                out, at = [], []
                for size, put in self.prefixes(part):
                    if m.collapse and not started and not out and put == " ":
                        done += size
                        continue
                    while after_space and put.startswith(" "):
                        put = put[1:]
                    if put:
                        after_space = m.collapse and put.endswith(" ")
                        put = put.replace(" ", self.space)
                        out.append(put)
                        at += [done] * len(put.encode("utf-8"))
                    elif not m.collapse:
                        after_space = False
                    done += size
                offsets = np.array(at, np.int64)
            whole = "".join(out)
            end = done
            if m.collapse and last:
                size = len(self.space.encode())
                while whole.endswith(self.space):
                    whole, offsets, end = whole[: -len(self.space)], offsets[:-size], int(offsets[-size])
            first = int(offsets[0]) if len(offsets) else end
            if whole and not started and m.prefix and not m.suffix:
                whole, offsets = self.space + whole, np.concatenate([np.full(len(self.space.encode()), first), offsets])
            started = started or bool(whole)
            if last and started and m.prefix and m.suffix:
                whole, offsets = whole + self.space, np.concatenate([offsets, np.full(len(self.space.encode()), end)])
            if whole:
                yield whole, np.append(offsets, end)


class Lockstep:
    """Segments of one length merged together: in each step every row merges its leftmost pair of the best score, so all rows
    that are not done stay equally long. Symbols are pieces and single characters by number."""

    NONE = np.iinfo(np.int32).max
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, rank_of: dict[str, int], ids_of: Callable[[str], tuple[list[int], list[int]]]):
        """ids_of: the ids of a symbol, and how many bytes each takes."""
        symbols = list(dict.fromkeys([*rank_of, *(c for p in rank_of for c in p), *map(chr, range(128))]))
        number = {x: k for k, x in enumerate(symbols)}
        self.n = len(symbols)
        self.of_char = np.full(0x110000, -1, np.int32)
        for x, k in number.items():
            if len(x) == 1:
                self.of_char[ord(x)] = k
        self.rank = np.array([rank_of.get(x, self.NONE) for x in symbols] + [self.NONE], np.int32)  # the last one: no such pair
        made = {number[p[:k]] * self.n + number[p[k:]]: number[p] for p in rank_of for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.shift = np.uint64(64 - max(4, (4 * len(made)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.made = np.full(len(self.keys), self.n, np.int32)
        self.probes = 1
        for key, slot, symbol in zip(made, self.slots(np.array(list(made), np.int64)).tolist(), made.values(), strict=True):
            probes = 1
            while self.keys[slot] >= 0:
                slot, probes = (slot + 1) % len(self.keys), probes + 1
            self.keys[slot], self.made[slot], self.probes = key, symbol, max(self.probes, probes)
        outs = [ids_of(x) for x in symbols]
        self.count = np.array([len(ids) for ids, _ in outs], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.ids, self.sizes = (np.array([x for out in outs for x in out[k]], "<u4") for k in (0, 1))

    def slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * self.MIX) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges to, n where it doesn't."""
        key = left.astype(np.int64) * self.n + right
        slot = self.slots(key)
        held = self.keys[slot]
        out = np.where(held == key, self.made[slot], self.n)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            held = self.keys[slot[open_]]
            out[open_] = np.where(held == key[open_], self.made[slot[open_]], self.n)
            open_ = open_[(held != key[open_]) & (held >= 0)]
        return out

    def encode(self, segments: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(place, ids, sizes) of the segments, all of one length, that hold no other characters than symbols."""
        size = len(segments[0])
        parts = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")].reshape(-1, size)
        rows = np.flatnonzero((parts >= 0).all(axis=1))
        parts = parts[rows]
        ranks = self.rank[self.pairs(parts[:, :-1].ravel(), parts[:, 1:].ravel())].reshape(len(rows), size - 1)
        while len(rows):
            each = np.arange(len(rows))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            going = ranks[each, at] < self.NONE if ranks.shape[1] else np.zeros(len(rows), bool)
            if not going.all():
                yield from self.told(rows[~going], parts[~going])
                rows, parts, ranks, at = rows[going], parts[going], ranks[going], at[going]
                if not len(rows):
                    break
                each = np.arange(len(rows))
            n = parts.shape[1]
            parts[each, at] = self.pairs(parts[each, at], parts[each, at + 1])
            keep = np.ones(parts.shape, bool)
            keep[each, at + 1] = False
            parts = parts[keep].reshape(len(rows), n - 1)
            ranks = ranks[np.arange(n - 1) != at[:, None]].reshape(len(rows), n - 2)
            for left in (at - 1, at):
                has = np.flatnonzero((left >= 0) & (left < n - 2))
                where = left[has]
                ranks[has, where] = self.rank[self.pairs(parts[has, where], parts[has, where + 1])]

    def told(self, rows: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        count = self.count[parts]
        each = count.ravel()
        place = np.repeat(self.first[parts].ravel() - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        ids, sizes = self.ids[place].tobytes(), self.sizes[place].tobytes()
        begin = 0
        for row, n in zip(rows.tolist(), (4 * count.sum(axis=1)).tolist(), strict=True):
            yield row, ids[begin : begin + n], sizes[begin : begin + n]
            begin += n


class Codec:
    """Ids, spans and back again."""

    def __init__(self, data: bytes):
        m = self.m = Model(data)
        self.normaliser = Normaliser(m)
        plain = [i for i, k in enumerate(m.kinds) if k in (NORMAL, USER_DEFINED, UNUSED)]
        self.id_of = {m.pieces[i]: i for i in plain}
        self.known_piece = {p: (i, len(p.encode("utf-8")) - 2 * p.count(MARK) * m.escape) for p, i in self.id_of.items()}.get
        places = {s: k for k, s in enumerate(sorted({m.scores[i] for i in plain}, reverse=True))}
        self.rank_of = {m.pieces[i]: places[m.scores[i]] for i in plain}
        self.unused = {m.pieces[i] for i in plain if m.kinds[i] == UNUSED}
        self.unknown = m.kinds.index(UNKNOWN) if UNKNOWN in m.kinds else 0
        self.byte_ids = {int(m.pieces[i][3:5], 16): i for i, k in enumerate(m.kinds) if k == BYTE}
        inner = re.compile(f"[^{MARK}]{MARK}")
        apart = m.escape and m.user_defined is None and not any(inner.search(p) for p in self.id_of)
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if apart else lambda text: [text]
        self.known: dict[str, tuple[bytes, bytes, str]] = {}
        self.older: dict[str, tuple[bytes, bytes, str]] = {}
        self.held = 0
        self.lockstep = Lockstep(self.rank_of, self.ids_of) if m.user_defined is None and not self.unused else None
        self.marks = np.array([p.count(MARK) if k in (NORMAL, USER_DEFINED, UNUSED) else 0 for p, k in zip(m.pieces, m.kinds, strict=True)])
        self.direct = self.normaliser.plain and apart and m.prefix and not m.suffix and m.byte_fallback and MARK in self.id_of
        self.decimals = list(map(str, range(len(m.pieces))))
        surfaces = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: m.unknown_surface.encode()}
        self.surface = [surfaces.get(k, lambda p: p.replace(MARK, " ").encode())(p) for p, k in zip(m.pieces, m.kinds, strict=True)]
        self.lengths = np.array(list(map(len, self.surface)), np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.all_surfaces = np.frombuffer(b"".join(self.surface), np.uint8)
        self.starts_marked = [k not in surfaces and p.startswith(MARK) for p, k in zip(m.pieces, m.kinds, strict=True)]

    def merged(self, parts: list[str], frozen: set[int]) -> list[str]:
        """Merge neighbours, best score first and leftmost of equals."""
        rank = self.rank_of.get
        halves: dict[str, tuple[str, str]] = {}
        if len(parts) <= LONG and not frozen and not self.unused:
            ranks = [rank(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
            while ranks and (least := min(ranks)) < NO_RANK:
                k = ranks.index(least)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del ranks[k]
                if k:
                    ranks[k - 1] = rank(parts[k - 1] + parts[k], NO_RANK)
                if k < len(ranks):
                    ranks[k] = rank(parts[k] + parts[k + 1], NO_RANK)
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, str, str]] = []

        def offer(left: int, right: int) -> None:
            if left < 0 or right >= len(parts) or left in frozen or right in frozen:
                return
            a, b = parts[left], parts[right]
            if (place := rank(a + b)) is not None:
                heapq.heappush(heap, (place, left, a, b))
                if a + b in self.unused:
                    halves[a + b] = a, b

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, left, a, b = heapq.heappop(heap)
            right = after[left]
            if parts[left] != a or right >= len(parts) or parts[right] != b:
                continue
            parts[left], parts[right], after[left] = a + b, "", after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])

        def whole(piece: str) -> Iterator[str]:
            if piece in halves:
                for half in halves[piece]:
                    yield from whole(half)
            else:
                yield piece

        return [p for part in parts if part for p in whole(part)] if self.unused else [p for p in parts if p]

    def symbols(self, segment: str) -> tuple[list[str], set[int]]:
        own = self.m.user_defined
        if own is None:
            return list(segment), set()
        parts, frozen, at = [], set(), 0
        for found in own.finditer(segment):
            parts += segment[at : found.start()]
            frozen.add(len(parts))
            parts.append(found.group())
            at = found.end()
        return parts + list(segment[at:]), frozen

    def encode_segment(self, segment: str) -> tuple[list[int], list[int]]:
        """Ids, and how many bytes each takes, a mark counting as one; of a character's byte pieces the last takes all."""
        ids, sizes = [], []
        for piece in self.merged(*self.symbols(segment)):
            if (found := self.known_piece(piece)) is not None:
                ids.append(found[0])
                sizes.append(found[1])
            else:
                some, each = self.ids_of(piece)
                ids += some
                sizes += each
        return ids, sizes

    def ids_of(self, piece: str) -> tuple[list[int], list[int]]:
        if (found := self.known_piece(piece)) is not None:
            return [found[0]], [found[1]]
        raw = piece.encode("utf-8")
        return ([self.byte_ids[b] for b in raw], [0] * (len(raw) - 1) + [len(raw)]) if self.m.byte_fallback else ([self.unknown], [len(raw)])

    def learn(self, segments: set[str]) -> None:
        """Make sure that all these segments are known. Those of the last generation but one are forgotten."""
        if self.held > CACHE_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        fresh: dict[int, list[str]] = {}
        for s in segments.difference(self.known):
            if (found := self.older.get(s)) is None:
                fresh.setdefault(len(s), []).append(s)
            else:
                self.keep(s, found)
        for size, alike in fresh.items():
            left = set(range(len(alike)))
            if self.lockstep and len(alike) >= TOGETHER and size <= LONG:
                for k, ids, sizes in self.lockstep.encode(alike):
                    self.keep(alike[k], (ids, sizes, ",".join([self.decimals[i] for i in memoryview(ids).cast("I")])))
                    left.discard(k)
            for k in left:
                ids, sizes = self.encode_segment(alike[k])
                self.keep(alike[k], (array("I", ids).tobytes(), array("I", sizes).tobytes(), ",".join([self.decimals[i] for i in ids])))

    def keep(self, segment: str, found: tuple[bytes, bytes, str]) -> None:
        self.known[segment] = found
        self.held += 330 + 4 * len(segment) + 5 * len(found[0])

    def ahead(self, texts: list[str]) -> None:
        """Learn the segments of several texts of together about STEP characters at once; longer texts and those that are normalised
        piece by piece are left to `encode`."""
        if self.direct:
            self.learn({s for text in texts if len(text) <= STEP and MARK not in text for s in self.split(MARK + text.replace(" ", MARK))})

    def encode(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """(ids, span begins, span ends, decimal ids joined by commas) of the text's successive chunks."""
        if self.direct and MARK not in text:  # a blank is a mark and takes one byte: sizes count bytes of the source
            done = -1  # the mark that normalisation puts in front
            for part in self.normaliser.cut(text) if text else ():
                segments = self.split((MARK + part if done < 0 else part).replace(" ", MARK))
                ids, sizes, decimals = self.looked_up(segments)
                ends = np.cumsum(sizes, dtype=np.int64) + done
                begins = np.concatenate([[max(done, 0)], ends[:-1]])
                done = int(ends[-1])
                yield ids, begins, ends, decimals
            return
        for chunk, offsets in self.normaliser.chunks(text):
            ids, sizes, decimals = self.looked_up(self.split(chunk))
            ends = np.cumsum(sizes + 2 * self.marks[ids] if self.m.escape else sizes, dtype=np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            if not self.m.byte_fallback:
                run = (ids == self.unknown) & np.concatenate([[False], ids[:-1] == self.unknown])
                if run.any():
                    ids, begins, ends = ids[~run], begins[~run], ends[np.append(~run[1:], True)]
                    decimals = ",".join(map(str, ids.tolist()))
            yield ids, offsets[begins], offsets[ends], decimals

    def looked_up(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, str]:
        try:
            found = list(map(self.known.__getitem__, segments))
        except KeyError:
            self.learn(set(segments))
            found = map(self.known.__getitem__, segments)
        ids, sizes, decimals = zip(*found, strict=True)
        return np.frombuffer(b"".join(ids), "<u4"), np.frombuffer(b"".join(sizes), "<u4"), ",".join(decimals)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that the ids stand for. At its start the marks that normalisation adds go."""
        out, at = [], 0
        if self.m.prefix or self.m.collapse:
            while at < len(ids):
                i = int(ids[at])
                if self.m.kinds[i] == BYTE:
                    break
                part = self.surface[i][1:] if self.starts_marked[i] else self.surface[i]
                out.append(part)
                at += 1
                if part or self.starts_marked[i] and not self.m.collapse:
                    break
        for k in range(at, len(ids), STEP):
            part = np.asarray(ids[k : k + STEP], np.int64)
            sizes = self.lengths[part]
            ends = np.cumsum(sizes)
            out.append(self.all_surfaces[np.repeat(self.places[part] - (ends - sizes), sizes) + np.arange(int(ends[-1]))].tobytes())
        text = b"".join(out)
        try:
            text.decode("utf-8")
        except UnicodeDecodeError:
            text = text.decode("utf-8", "each-byte").encode("utf-8")
        return text


@functools.lru_cache(1)
def codec_of(data: bytes) -> Codec:
    """One codec a worker; it outlives a task."""
    return Codec(data)


ENCODED = "id long, ids array<int>, begins array<long>, ends array<long>, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, span_bytes long"


def encoded(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Ids, spans of source bytes and the decoded text of each row, or their digests (n_bytes: where the last span ends;
    span_bytes: what all spans hold together).

    The model file is read on the driver and broadcast: its size is fixed, whatever the corpus.
    """
    import pyarrow as pa

    from echoline.llm.base import bound_batches, spark_to_arrow

    spark = df.sparkSession
    bound_batches(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    schema = DIGESTS if digest else ENCODED
    fields = spark_to_arrow(spark, schema)

    def groups(texts: list[str]) -> Iterator[list[str]]:
        some, room = [], STEP
        for text in texts:
            if some and len(text) > room:
                yield some
                some, room = [], STEP
            some.append(text)
            room -= len(text)
        yield some

    def row(codec: Codec, doc: int | None, text: str) -> tuple:
        parts = list(codec.encode(text))
        ids, begins, ends = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(3))
        back = codec.decode(ids)
        if not digest:
            return doc, ids, begins, ends, back
        sha = hashlib.sha256()
        for k, part in enumerate(parts):
            sha.update(("," * bool(k) + part[3]).encode())
        return doc, len(ids), sha.hexdigest(), hashlib.sha256(back).hexdigest(), int(ends[-1]) if len(ends) else 0, int((ends - begins).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for batch in batches:
            docs, texts = (c.to_pylist() for c in batch.columns)
            ids, rows = iter(docs), []
            for some in groups([(text or b"").decode("utf-8", "replace") for text in texts]):
                codec.ahead(some)
                rows += [row(codec, next(ids), text) for text in some]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return binary_text(df, id_col, text_col).mapInArrow(run, schema)
