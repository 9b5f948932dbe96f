"""Fuzzy occurrences of target lines in timed words.

Up to CHUNK characters of targets (some twenty thousand lines) are broadcast and transcripts never move; more targets and the
transcripts are dealt to a grid of blocks (`against`). A transcript is tokenised once a block, and a filter (`Bank`, BANK
targets each) names the few targets that it may hold. Only for those are windows scored, all lengths from one start in one
pass, and the chronological, non-overlapping occurrences are selected on the spot.

Candidates don't come from an index of pieces: at a similarity of 85 a quarter of a line's characters may be missing,
evenly spread, so that no piece of four characters needs to be intact and an equi-join on pieces would lose matches.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.functions.similarity import Bank, lcs_prefixes, masks
from echoline.functions.text import assemble, matching_tokens, transcript_tokens
from echoline.schemas import OCCURRENCES

#: Characters of targets that are broadcast or that a block of the grid holds, bytes of a group of rows, targets of one filter.
CHUNK, CELL, BANK = 4 << 20, 16 << 20, 256
#: Bytes a core below which a table is dealt out evenly before it is searched.
SMALL = 64 << 20
#: Bytes of a batch that become Python objects at once, windows whose scores are kept for a repeat.
PART, MEMO = 1 << 20, 1 << 13
SHORT_TOKENS, SHORT_LETTERS = 1, 4

Token = tuple[str, int, int]
Window = tuple[int, int, float]  # start, length, score


def window_lengths(n: int) -> range:
    """Window lengths to try for a target of n tokens."""
    slack = max(1, min(3, math.ceil(n / 4)))
    return range(max(1, n - slack), n + slack + 1)


def scored_windows(tokens: list[Token], target: list[str], lengths: range, least: float = 0.0, repeats: bool = True) -> Iterator[Window]:
    """(start, length, score) of each window that fits and scores `least`, by start and length. Words that were met before are not
    scored again; without repeats they aren't given again either."""
    text = " ".join(target)
    of, n, low, high = masks(text), len(text), lengths[0], lengths[-1]
    words, known = [t for t, _, _ in tokens], {}
    for start in range(len(words) - low + 1):
        part = tuple(words[start : start + high])
        found = known.get(part)
        if found is None:
            ends, at = {}, -1
            for length, t in enumerate(part, 1):
                at += len(t) + 1
                if length in lengths:
                    ends[at] = length
            sized = ((ends[size], 200.0 * common / (n + size)) for size, common in enumerate(lcs_prefixes(of, n, " ".join(part)), 1) if size in ends)
            found = [w for w in sized if w[1] >= least]
            if len(known) < MEMO:
                known[part] = found
        elif not repeats:
            continue
        for length, score in found:
            yield start, length, score


def survivors(tokens: list[Token], target: list[str], threshold: float) -> list[Window]:
    """Windows that may become occurrences: all later steps look at no others."""
    least = 100.0 if len(target) <= SHORT_TOKENS and len(target[0]) <= SHORT_LETTERS else threshold
    return list(scored_windows(tokens, target, window_lengths(len(target)), least))


def select(windows: Iterable[Window], tokens: list[Token], n: int) -> list[Window]:
    """Non-overlapping occurrences in order of time.

    The earliest start with an acceptable window anchors an occurrence; a better window that starts within the anchor
    replaces it (higher score, then closer length, then earlier start). The next search starts behind the occurrence and
    behind the word that its last token begins in.
    """
    at_start: dict[int, list[Window]] = {}
    for w in windows:
        at_start.setdefault(w[0], []).append(w)
    order, chosen, free, k = sorted(at_start), [], 0, 0
    rank = lambda w: (w[2], -abs(w[1] - n), -w[0])
    while k < len(order):
        if order[k] < free:
            k += 1
            continue
        anchor = max(at_start[order[k]], key=lambda w: (w[2], -w[1]))
        rivals = [w for s in order[k + 1 :] if s < anchor[0] + anchor[1] for w in at_start[s]]
        best = max([anchor, *rivals], key=rank)
        chosen.append(best)
        free, word = best[0] + best[1], tokens[best[0] + best[1] - 1][1]
        while free < len(tokens) and tokens[free][1] <= word:
            free += 1
    return chosen


def best_window(tokens: list[Token], target: list[str]) -> Window | None:
    """The best window of all, whatever its score; lengths are cut to a short transcript's."""
    if not tokens or not target:
        return None
    lengths = window_lengths(len(target))
    high = min(len(tokens), lengths[-1])
    fitting = scored_windows(tokens, target, range(min(lengths[0], high), high + 1), repeats=False)  # of equal ones the earliest wins
    return max(fitting, key=lambda w: (w[2], -abs(w[1] - len(target)), -w[0]), default=None)


class Spoken:
    """The words of one transcript: texts as Python strings, a word as a dict when it is asked for."""

    def __init__(self, words: pa.Scalar):
        rows = words.values
        self.texts = rows.field("text").to_pylist() if rows is not None else []
        self.times = [rows.field(c) for c in ("start", "end")] if rows is not None else []

    def __getitem__(self, k: int | slice) -> dict | list[dict]:
        if isinstance(k, slice):
            return [self[i] for i in range(*k.indices(len(self.texts)))]
        start, end = (t[k].as_py() for t in self.times)
        return {"text": self.texts[k], "start": start, "end": end}


def spoken_words(column: pa.Array) -> list[Spoken]:
    return [Spoken(words) for words in column]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of one row or at most PART bytes: what is turned into Python objects at once is bounded, however
    long the rows are."""
    if batch.num_rows > 1 and batch.nbytes > PART:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))
    elif batch.num_rows:
        yield batch


def describe(window: Window, tokens: list[Token], words: list[dict] | Spoken) -> tuple[str, float, float, str, float]:
    """(matched text, start, end, match type, score) in terms of the source words."""
    start, length, score = window
    first, last = tokens[start][1], max(t[2] for t in tokens[start : start + length])
    return assemble([w["text"] or "" for w in words[first : last + 1]]), words[first]["start"], words[last]["end"], "exact" if score == 100.0 else "fuzzy", score


def transcripts(words: DataFrame, *keys: str) -> DataFrame:
    """One row for each medium (and further keys): its words in order."""
    ordered = F.array_sort(F.collect_list(F.struct("word_idx", "text", "start", "end")))
    return words.groupBy("media_id", *keys).agg(F.transform(ordered, lambda w: F.struct(w["text"].alias("text"), w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end"))).alias("words"))


def spoken(df: DataFrame, id_col: str, text_col: str, seconds_a_word: float = 0.4) -> DataFrame:
    """Transcripts from plain texts: word k is spoken from k to k + 1 word lengths."""
    rows = spread(df.select(df[id_col].cast("long").alias("media_id"), df[text_col].alias("text")))  # texts are dealt out, not their words
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != "")
    timed = F.transform(parts, lambda w, k: F.struct(w.alias("text"), (k * seconds_a_word).alias("start"), ((k + 1) * seconds_a_word).alias("end")))
    return rows.select("media_id", timed.alias("words"))


Asked = list[tuple[int, str]]


def against(rows: DataFrame, targets: DataFrame, ready: Callable[[Asked], list], work: Callable[[list], Callable[[pa.RecordBatch], list[tuple]]], schema: str, size: Column, *keys: str) -> DataFrame:
    """What work(ready(targets)) finds in all batches of rows.

    Targets of at most CHUNK characters, which is measured first, are broadcast, and rows stay where they are. More make a grid: targets
    are dealt by a hash to blocks of about CHUNK characters, rows by a hash of keys to groups of about CELL bytes (size: the bytes
    of a row), and each pair of block and group is one cell, which holds these two only. A row is sent once for each block and a
    target once for each group; the driver sees two sums, and a lost executor costs its cells.
    """
    asked, fields = targets.select("query_id", "text"), arrow_fields(rows, schema)
    volume = asked.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 16).alias("n")).first()["n"] or 0
    if volume <= CHUNK:
        sent = rows.sparkSession.sparkContext.broadcast(ready([(r["query_id"], r["text"]) for r in asked.collect()]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one = work(sent.value)
            for batch in batches:
                for part in slices(batch):
                    if found := one(part):
                        yield record_batch(found, fields)

        return spread(rows).mapInArrow(run, schema)
    blocks, groups = -(-volume // CHUNK), max(1, -(-(rows.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0) // CELL))
    names, cell = rows.columns, ["__group", "__block"]
    deal = lambda columns, n: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("__group", deal(keys, groups)).withColumn("__block", every(blocks))
    right = asked.withColumn("__block", deal(["query_id", "text"], blocks)).withColumn("__group", every(groups))

    def meet(some: pa.Table, lines: pa.Table) -> pa.Table:
        if not some.num_rows or not lines.num_rows:
            return fields.empty_table()
        one = work(ready(list(zip(lines["query_id"].to_pylist(), lines["text"].to_pylist(), strict=True))))
        parts = (part for batch in some.select(names).combine_chunks().to_batches(max_chunksize=256) for part in slices(batch))
        return pa.Table.from_batches([record_batch(found, fields) for part in parts if (found := one(part))], fields)

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, schema)


class Banks:
    """Filters for any number of targets; `many` gives for each text the numbers of the targets it may hold, `starts` the words of a
    text with which a target's windows may begin."""

    def __init__(self, targets: list[str], threshold: float, sizes: list[int] | None = None):
        self.banks = [(k, Bank(targets[k : k + BANK], threshold, sizes and sizes[k : k + BANK])) for k in range(0, len(targets), BANK)]

    def many(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for first, bank in self.banks:
            for found, ks in zip(out, bank.many(texts), strict=True):
                found.extend(first + k for k in ks)
        return out

    def starts(self, target: int, words: list[str], lengths: range, space: int) -> list[int]:
        """space: the characters between two words, 0 where targets are looked for without spaces."""
        bank = self.banks[target // BANK][1]
        behind = [0, *itertools.accumulate(len(w) + space for w in words)]  # the end of k words is space before it
        if target % BANK in bank.always:
            return list(range(len(words)))
        text = (" " * space).join(words)
        hits = set(bank.ends(target % BANK, text))
        last = [k for k in range(1, len(words) + 1) if behind[k] - space in hits]
        return sorted({k - n for k in last for n in lengths if k >= n})


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small (few files may hold it); a large table, or one that was dealt out before, is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))  # the planner's estimate
    return df.repartition(4 * cores) if size < SMALL * cores and "Repartition " not in plan.toString() else df


def arrow_fields(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def record_batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def skipping(rows: DataFrame, targets: DataFrame, done: DataFrame | None) -> DataFrame:
    """rows with `skip`, the queries that done (query_id, media_id) answers for the row's medium; a medium with an answer
    for every target is left out."""
    if done is None:
        return rows.withColumn("skip", F.array().cast("array<bigint>"))
    answered = done.groupBy("media_id").agg(F.collect_set(F.col("query_id").cast("long")).alias("skip"))
    rows = rows.join(answered, "media_id", "left").withColumn("skip", F.coalesce("skip", F.array().cast("array<bigint>")))
    return rows.where(F.size("skip") < targets.select("query_id").distinct().count())


def occurrences(media: DataFrame, targets: DataFrame, threshold: float = 85.0, done: DataFrame | None = None) -> DataFrame:
    """OCCURRENCES of every target in every transcript. Targets without a letter or digit find nothing (see `errors`).
    Pairs (query_id, media_id) of done are not looked for."""

    def ready(part: Asked) -> list:
        return [(q, m) for q, m in ((q, matching_tokens(t or "")) for q, t in part) if m]

    def work(known: list) -> Callable[[pa.RecordBatch], list[tuple]]:
        banks = Banks([" ".join(m) for _, m in known], threshold)

        def one(batch: pa.RecordBatch) -> list[tuple]:
            rows = []
            media_ids, heard, skips = batch.column(0).to_pylist(), spoken_words(batch.column(1)), batch.column(2).to_pylist()
            tokens = [transcript_tokens(words.texts) for words in heard]
            candidates = banks.many([" ".join(t for t, _, _ in ts) for ts in tokens])
            for media_id, words, skip, ts, ks in zip(media_ids, heard, skips, tokens, candidates, strict=True):
                answered = set(skip)
                for query_id, target in (known[k] for k in ks if known[k][0] not in answered):
                    found = select(survivors(ts, target, threshold), ts, len(target))
                    rows += [(query_id, media_id, n, *describe(w, ts, words)) for n, w in enumerate(found)]
            return rows

        return one

    open_media = skipping(media.select("media_id", "words"), targets, done)
    return against(open_media, targets, ready, work, OCCURRENCES, 24 * F.greatest(F.size("words"), F.lit(1)), "media_id")


TOKENS = "media_id long, tok_idx int, token string, first_word int, last_word int"


def token_spans(media: DataFrame) -> DataFrame:
    """TOKENS of rows (media_id, words): the canonical tokens of each transcript and the words that each was made of."""
    fields = arrow_fields(media, TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            columns = zip(batch.column(0).to_pylist(), spoken_words(batch.column(1)), strict=True)
            rows = [(media_id, k, *token) for media_id, words in columns for k, token in enumerate(transcript_tokens(words.texts))]
            if rows:
                yield record_batch(rows, fields)

    return media.select("media_id", "words").mapInArrow(run, TOKENS)


BEST = OCCURRENCES.replace("occ_idx int, ", "")


def best_windows(pairs: DataFrame) -> DataFrame:
    """(query_id, media_id, matched_text, start, end, match_type, score) for rows (query_id, media_id, target, words):
    the best window of each, for diagnosis and for the precision gate."""
    fields = arrow_fields(pairs, BEST)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for query_id, media_id, target, words in zip(*(batch.column(k).to_pylist() for k in range(3)), spoken_words(batch.column(3)), strict=True):
                tokens = transcript_tokens(words.texts)
                if found := best_window(tokens, matching_tokens(target or "")):
                    rows.append((query_id, media_id, *describe(found, tokens, words)))
            if rows:
                yield record_batch(rows, fields)

    return pairs.select("query_id", "media_id", "target", "words").mapInArrow(run, BEST)


def best_of_all(media: DataFrame, targets: DataFrame) -> DataFrame:
    """best_windows of every target in every transcript; transcripts aren't copied for their targets."""

    def ready(part: Asked) -> list:
        return [(q, m) for q, m in ((q, matching_tokens(t or "")) for q, t in part) if m]

    def work(known: list) -> Callable[[pa.RecordBatch], list[tuple]]:
        def one(batch: pa.RecordBatch) -> list[tuple]:
            rows = []
            for media_id, words in zip(batch.column(0).to_pylist(), spoken_words(batch.column(1)), strict=True):
                tokens = transcript_tokens(words.texts)
                rows += [(query_id, media_id, *describe(found, tokens, words)) for query_id, target in known if (found := best_window(tokens, target))]
            return rows

        return one

    return against(media.select("media_id", "words"), targets, ready, work, BEST, 24 * F.greatest(F.size("words"), F.lit(1)), "media_id")


def errors(targets: DataFrame, media: DataFrame) -> DataFrame:
    """(query_id, media_id, message): targets and transcripts that can't match; failures are rows, never exceptions."""
    word = lambda c: F.coalesce(c, F.lit("")).rlike(r"[\p{L}\p{N}]|\$\s*\p{Nd}")
    bad_targets = targets.where(~word(F.col("text"))).select("query_id", F.lit(None).cast("long").alias("media_id"), F.lit("Target dialogue must contain at least one letter or number.").alias("message"))
    silent = media.where(~F.exists(F.coalesce("words", F.array().cast("array<struct<text:string,start:double,end:double>>")), lambda w: word(w["text"])))
    return bad_targets.unionByName(silent.select(F.lit(None).cast("long").alias("query_id"), "media_id", F.lit("Transcription contains no matchable words.").alias("message")))
