"""Normalised Indel similarity: 200 * LCS(a, b) / (len(a) + len(b)) on code points.

The longest common subsequence is found bit-parallel: one big integer holds a row of the dynamic programme, a step takes
one character of the other string. The corpus-wide filter (`Bank`) tracks pieces of many targets in machine words.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Shorter strings of more characters are compared with all windows of the longer one at once.
COMBED = 32
#: Pairs of strings that are combed at once, and about how many characters they may have.
TOGETHER, VOLUME = 128, 1 << 20


def masks(text: str) -> dict[str, int]:
    """Character -> bits of the places where it stands."""
    out: dict[str, int] = {}
    for k, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << k
    return out


def lcs_prefixes(of: dict[str, int], n: int, text: str) -> Iterator[int]:
    """LCS of a pattern of n characters (as masks) and each prefix of text that has one character more."""
    full = row = (1 << n) - 1
    for c in text:
        hit = row & of.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
        yield n - row.bit_count()


def lcs(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    of, full = masks(a), (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & of.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100; two empty strings are equal."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def compact_ratio(a: str, b: str) -> float:
    """The better of the ratio and the ratio without spaces."""
    return max(ratio(a, b), ratio(a.replace(" ", ""), b.replace(" ", "")))


def _combed_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """partial_ratio one way round for pairs (short, long), all windows of all pairs at once: semi-local LCS by combing seaweeds, an
    anti-diagonal at a time.

    A seaweed enters at the left of each row or the top of each column; two that meet cross once at most, and not at equal
    characters. LCS(short, long[i:j]) is j - i less the seaweeds that enter and leave within columns i to j. Pairs of less than
    the greatest lengths are padded with rows and columns that seaweeds pass straight.
    """
    m, n = (max(len(p[k]) for p in pairs) for k in (0, 1))
    kind = np.int16 if m + n < 1 << 14 else np.int32
    codes: dict[str, int] = {}
    coded = lambda text: [codes.setdefault(c, len(codes)) for c in text]
    rows, columns = np.full((m, len(pairs)), -1, np.int32), np.full((n, len(pairs)), -2, np.int32)
    h, v = np.full((m, len(pairs)), -1, kind), np.full((n, len(pairs)), np.iinfo(kind).max, kind)
    for k, (short, long) in enumerate(pairs):
        rows[m - len(short) :, k], columns[: len(long), k] = coded(reversed(short)), coded(long)
        h[m - len(short) :, k], v[: len(long), k] = np.arange(len(short)), np.arange(len(short), len(short) + len(long))
    if len(codes) < 1 << 15:
        rows, columns = rows.astype(np.int16), columns.astype(np.int16)
    for d in range(m + n - 1):
        first, last = max(0, d - n + 1), min(d, m - 1)
        left, top = slice(m - 1 - last, m - first), slice(d - last, d - first + 1)
        a, b = h[left], v[top]
        turn = rows[left] == columns[top]
        turn |= a > b
        change = a ^ b
        change *= turn
        a ^= change
        b ^= change
    return [_best_share(len(short), len(long), v[: len(long), k].astype(np.int64) - len(short)) for k, (short, long) in enumerate(pairs)]


def _best_share(m: int, n: int, entry: np.ndarray) -> float:
    """The best ratio of all windows; entry: the column in which the seaweed that leaves below each column entered, negative for rows."""
    inside = np.flatnonzero(entry >= 0)
    lost = np.zeros(n + 1, np.int64)  # by window start: seaweeds within the m columns from there
    begin, end = np.maximum(inside - m + 1, 0), entry[inside] + 1
    np.add.at(lost, begin[begin < end], 1)
    np.add.at(lost, end[begin < end], -1)
    size = np.minimum(m, n - np.arange(n))
    best = (200.0 * (size - np.cumsum(lost)[:n]) / (m + size)).max()
    k = np.arange(1, min(m, n) + 1)
    return float(max(best, (200.0 * (k - np.cumsum(entry[: len(k)] >= 0)) / (m + k)).max()))


def _tried_ratio(short: str, long: str) -> float:
    """partial_ratio one way round, window by window."""
    n, of, best = len(short), masks(short), 0.0
    for start in range(len(long)):
        window = long[start : start + n]
        got = 0
        for got in lcs_prefixes(of, n, window):
            pass
        best = max(best, 200.0 * got / (n + len(window)))
    for k, got in enumerate(lcs_prefixes(of, n, long[:n]), 1):
        best = max(best, 200.0 * got / (n + k))
    return best


def partial_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """partial_ratio of each pair; pairs of like lengths are compared together."""
    out, ways = [0.0] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        if not a or not b:
            out[k] = 100.0 if a == b else 0.0
            continue
        short, long = (b, a) if len(a) > len(b) else (a, b)
        for x, y in [(short, long), (long, short)][: 1 + (len(a) == len(b))]:
            if len(x) > COMBED:
                ways.append((len(x), len(y), k, x, y))
            else:
                out[k] = max(out[k], _tried_ratio(x, y))
    ways.sort(key=lambda w: (w[0] + w[1], w[2]))
    while ways:
        some = ways[-max(1, min(TOGETHER, VOLUME // (ways[-1][0] + ways[-1][1]))) :]
        del ways[-len(some) :]
        for (*_, k, _, _), score in zip(some, _combed_ratios([(x, y) for *_, x, y in some]), strict=True):
            out[k] = max(out[k], score)
    return out


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one, of its length or cut at either end; both ways
    round for equal lengths."""
    return partial_ratios([(a, b)])[0]


def length_bound(n: Column, m: Column, threshold: float) -> Column:
    """False where two strings of these lengths can't reach the threshold: LCS is at most the shorter length."""
    return F.least(n, m) * 200.0 >= (n + m) * threshold - 1e-9


def letters_bound(a: Column, b: Column, threshold: float, letters: str = "abcdefghijklmnopqrstuvwxyz ") -> Column:
    """False where the letters in common are too few: LCS is at most the overlap of the letter counts, letters outside
    the list counting as common as far as either side has them."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    listed = sum((F.least(count(a, c), count(b, c)) for c in letters), F.lit(0))
    rest = F.least(*[F.length(F.translate(s, letters, "")) for s in (a, b)])
    return (listed + rest) * 200.0 >= (F.length(a) + F.length(b)) * threshold - 1e-9


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return udf


indel_ratio, compact_indel_ratio = _pairwise(ratio), _pairwise(compact_ratio)


@F.pandas_udf(T.DoubleType())
def partial_indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    there = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[there] = partial_ratios(list(zip(a[there], b[there], strict=True)))
    return pd.Series([x if t else None for x, t in zip(out, there, strict=True)], dtype="float64")


def evidence_conflicts(a: Column, b: Column, threshold: float = 85.0) -> Column:
    """Of two normalised texts: either is empty, or neither holds the other well enough."""
    return (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "") | (partial_indel_ratio(a, b) < threshold)


class Bank:
    """Targets side by side, to find texts that can't hold any of them; results are a superset of those that do.

    An Indel similarity of at least T to a window of m characters means at most (1 - T)(n + m) insertions and deletions,
    thus no larger Levenshtein distance, and m is at most n (2 - T) / T. If a target is cut into pieces of up to LANE
    characters, one piece at least has no more than its share of that distance to a substring. So texts are cut into
    overlapping segments, and the distance of every piece to its nearest substring is tracked bit-parallel in one machine
    word, for all pieces and BATCH segments at a time. What remains is looked at once more with whole targets (`nearest`).
    """

    LANE, BATCH, SEGMENT, STRIDE = 64, 32, 1024, 4

    def __init__(self, targets: list[str], threshold: float, sizes: list[int] | None = None):
        """sizes: the lengths that the limits go by, where targets are looked for without some of their characters."""
        t = threshold / 100
        self.targets = targets
        self.limits = np.array([math.floor(2 * n * (1 - t) / t + 1e-9) if t else 1 << 30 for n in sizes or map(len, targets)], np.int64)
        owner, pieces = [], []
        for k, text in enumerate(targets):
            parts = -(-len(text) // self.LANE)
            for j in range(parts):
                owner.append(k)
                pieces.append(text[len(text) * j // parts : len(text) * (j + 1) // parts])
        self.owner = np.array(owner, np.int64)
        size = np.array([len(x) for x in pieces], np.int64)
        whole = np.array([len(targets[k]) for k in owner], np.int64)
        self.share = self.limits[self.owner] * size // np.maximum(whole, 1)
        self.row = {c: r for r, c in enumerate(sorted({c for x in pieces for c in x}), 1)}
        self.equal = np.zeros((len(self.row) + 1, len(pieces)), np.uint64)
        for lane, x in enumerate(pieces):
            for k, c in enumerate(x):
                self.equal[self.row[c], lane] |= np.uint64(1 << k)
        self.full = np.array([(1 << len(x)) - 1 for x in pieces], np.uint64)
        self.least = (np.minimum(self.share, 250) + self.STRIDE // 2).astype(np.uint8)
        self.always = {k for k, x in enumerate(targets) if not x or self.limits[k] >= len(x)}
        self.overlap = -(-int((size + np.minimum(self.share, size)).max(initial=0)) // self.STRIDE) * self.STRIDE

    def many(self, texts: list[str]) -> list[list[int]]:
        """For each text the targets that may have a window in it."""
        segments = []
        for k, text in enumerate(texts):
            coded = np.fromiter(map(self.row.get, text, itertools.repeat(0)), np.int16, len(text))
            step = self.SEGMENT
            segments += [(k, coded[at : at + step + self.overlap]) for at in range(0, max(1, len(coded)), step) if len(coded)]
        segments.sort(key=lambda s: len(s[1]))
        found: list[set[int]] = [set(self.always) if t else set() for t in texts]
        for at in range(0, len(segments), self.BATCH):
            batch = segments[at : at + self.BATCH]
            for (k, _), hit in zip(batch, self.near([c for _, c in batch]), strict=True):
                found[k].update(self.owner[hit].tolist())
        return [sorted(k for k in ks if k in self.always or self.nearest(k, text, self.limits[k]) <= self.limits[k]) for ks, text in zip(found, texts, strict=True)]

    def candidates(self, text: str) -> list[int]:
        return self.many([text])[0]

    def near(self, segments: list[np.ndarray]) -> np.ndarray:
        """segments x lanes: whether a piece comes near enough anywhere in a segment. A distance moves by one a character
        at most, so it is enough to look every STRIDE characters and to allow for half as many more."""
        n = max(map(len, segments)) + self.STRIDE
        codes = np.zeros((n, len(segments)), np.int16)
        for k, c in enumerate(segments):
            codes[: len(c), k] = c
        shape = (len(segments), len(self.full))
        plus, minus = np.broadcast_to(self.full, shape).copy(), np.zeros(shape, np.uint64)
        across, down, eq, found = np.empty(shape, np.uint64), np.empty(shape, np.uint64), np.empty(shape, np.uint64), np.zeros(shape, bool)
        one = np.uint64(1)
        for k in range(n):
            np.take(self.equal, codes[k], 0, out=eq)
            np.bitwise_or(eq, minus, out=down)
            np.bitwise_and(eq, plus, out=across)
            across += plus
            across ^= plus
            across |= eq
            np.bitwise_or(across, plus, out=eq)  # from here on eq holds the steps up
            np.invert(eq, out=eq)
            eq |= minus
            across &= plus
            eq <<= one
            across <<= one
            np.bitwise_or(down, eq, out=plus)
            np.invert(plus, out=plus)
            plus |= across
            np.bitwise_and(eq, down, out=minus)
            if k % self.STRIDE == self.STRIDE // 2:
                found |= np.bitwise_count(plus & self.full) - np.bitwise_count(minus & self.full) <= self.least
        return found

    def nearest(self, target: int, text: str, enough: int = 0) -> int:
        """The Levenshtein distance of a whole target to its nearest substring of text, or to the first that is near enough."""
        best = len(self.targets[target])
        for distance in self.distances(target, text):
            if distance < best:
                best = distance
                if best <= enough:
                    return best
        return best

    def ends(self, target: int, text: str) -> list[int]:
        """Behind which characters of text a window may end that is similar enough: any such window has no larger distance."""
        limit = self.limits[target]
        return [k for k, distance in enumerate(self.distances(target, text), 1) if distance <= limit]

    def distances(self, target: int, text: str) -> Iterator[int]:
        """The Levenshtein distance of a whole target to the nearest substring that ends with each character of text."""
        x = self.targets[target]
        of, full, top = masks(x), (1 << len(x)) - 1, 1 << (len(x) - 1)
        plus, minus, distance = full, 0, len(x)
        for c in text:
            eq = of.get(c, 0)
            down = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(across | plus))
            fall = plus & across
            distance += (up & top != 0) - (fall & top != 0)
            yield distance
            up, fall = up << 1 & full, fall << 1 & full
            plus, minus = fall | (full & ~(down | up)), up & down
