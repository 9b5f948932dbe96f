"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lowers the text, strips accents, maps look-alike letters of other scripts and digits to Latin letters and drops
invisible characters, so that disguised spellings meet the plain ones. The lexicon holds whole words and word stems with
weights learned from labelled rows (smoothed log odds of documents); no word is built in. Matches inside an
exception phrase (a fixed one, or one that only clean rows have) don't count. The weights found are summed, divided by a
slowly growing function of the text's length, and calibrated to a probability by logistic regression on the same labelled rows.

The fit uses at most TRAIN_ROWS labelled rows of each class (a documented bound, chosen by a hash of the id), and the
lexicon holds the LEXICON_SIZE words and stems that stand in most toxic ones of these rows; scoring covers every text in full.

Defined results: null, empty and wordless texts score as texts without a match; labels that are null, or of other values than
0 and 1, teach nothing; with no toxic or no clean labelled row nothing is learned and no text is toxic; with no match in any
labelled row a fixed calibration decides; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.base import bound_batches, spark_to_arrow

TRAIN_ROWS, LEXICON_SIZE, STEM_MIN, STEM_MAX = 4000, 4000, 3, 8
#: A word or stem enters the lexicon if its smoothed odds ratio is at least ODDS and its rows lean to toxic beyond chance:
#: the log likelihood ratio must exceed the log of the number of candidates by EVIDENCE.
ODDS, EVIDENCE, LEAST_ROWS = 25.0, 2.0, 3

# Phrases in which such words are harmless, and look-alike letters.
EXCEPTIONS = ["trash can", "trash bin", "take out the trash", "circus clown", "clown fish", "class clown", "rodeo clown", "idiot proof", "idiot light"]
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ð": "d", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ß": "ss", "æ": "ae", "œ": "oe"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"


def fold_table() -> dict[int, str]:
    """Code point -> folded text: accents by canonical or compatibility decomposition, then the fixed values."""
    table: dict[int, str] = {}
    for low, high in ((0x80, 0x250), (0x1E00, 0x2000), (0x2100, 0x2190), (0x2460, 0x2500), (0xFF00, 0xFFF0), (0x1D400, 0x1D800)):
        for cp in range(low, high):
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c)).lower()
            if plain and plain != chr(cp) and plain.isascii() and plain.isalnum():
                table[cp] = "".join(DIGITS.get(c, c) for c in plain)
    table |= {cp: "" for cp in range(0x300, 0x370)} | {ord(c): "" for c in INVISIBLE}
    return table | {ord(k): v for k, v in (LOOKALIKES | DIGITS).items()}


TABLE = fold_table()
ALTERNATIVE = TABLE | {ord("1"): "l"}
BETWEEN = re.compile(r"(?<=[^\W\d_])[!|](?=[^\W\d_])")
AMBIGUOUS = re.compile(r"1[^\W\d_]|[^\W\d_]1")
WORDS = re.compile(r"[^\W_]+")


def fold(text: str, table: dict[int, str] = TABLE) -> str:
    low = text.lower()
    if "!" in low or "|" in low:
        low = BETWEEN.sub("i", low)
    return low.translate(table)


@dataclass
class Lexicon:
    """words and stems: folded spelling -> weight; exceptions: folded phrases; slope and bias: the calibration."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 6.0
    bias: float = -3.0


class Matcher:
    """A lexicon as an automaton."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        entries: dict[str, dict[str, float]] = {}
        for kind, found in (("word", lexicon.words), ("stem", lexicon.stems), ("except", dict.fromkeys(lexicon.exceptions, 0.0))):
            for spelling, weight in found.items():
                entries.setdefault(spelling, {})[kind] = weight
        for spelling, kinds in entries.items():
            self.automaton.add_word(spelling, (len(spelling), kinds))
        self.automaton.make_automaton()
        self.any = bool(entries)

    def matches(self, folded: str) -> dict[int, tuple[float, int]]:
        """Word start -> (weight, end) of the heaviest match there, without those inside an exception phrase."""
        found: dict[int, tuple[float, int]] = {}
        spared: list[tuple[int, int]] = []
        if not self.any:
            return found
        last = len(folded) - 1
        for end, (n, kinds) in self.automaton.iter(folded):
            start = end - n + 1
            if start and folded[start - 1].isalnum():
                continue
            whole = end == last or not folded[end + 1].isalnum()
            if whole and "except" in kinds:
                spared.append((start, end))
            weight = max(kinds.get("stem", 0.0), kinds.get("word", 0.0) if whole else 0.0)
            if weight > found.get(start, (0.0, 0))[0]:
                found[start] = (weight, end)
        for low, high in spared:
            for start in [s for s in found if low <= s <= high]:
                del found[start]
        return found

    def measure(self, text: str) -> tuple[float, int, int, str, dict[int, tuple[float, int]]]:
        """(length-normalised weight, matches, words, folded text, matches by place)."""
        folded = fold(text)
        found = self.matches(folded)
        if AMBIGUOUS.search(text):
            other = self.matches(fold(text, ALTERNATIVE))
            found = other | found  # the same places: both foldings give as many characters
        n_words = len(text.split())
        weight = sum(w for w, _ in found.values())
        return weight / math.log(math.e + n_words), len(found), n_words, folded, found

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.lexicon.slope * math.log1p(x) + self.lexicon.bias))))


def crc_of_id(id_column):
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"))


def train_rows(docs: DataFrame, labels: DataFrame, fold_column, most: int = TRAIN_ROWS) -> DataFrame:
    """(text, label): at most `most` labelled rows of each class; the ids that a hash puts first."""
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & fold_column(F.col("id")))
    order = (F.xxhash64("id"), "id")
    chosen = ids.where("label = 1").orderBy(*order).limit(most).unionByName(ids.where("label = 0").orderBy(*order).limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("text", "label")  # the chosen ids have a fixed bound


def _texts(batch) -> list[tuple[str, int]]:
    return [((t or b"").decode("utf-8", "replace"), y) for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)]


def count_features(rows: DataFrame) -> DataFrame:
    """(kind, spelling, toxic, clean): in how many rows of each class a word or stem stands."""
    bound_batches(rows.sparkSession)
    schema = "kind string, spelling string, toxic long, clean long"
    fields = spark_to_arrow(rows.sparkSession, schema)

    def run(batches):
        for batch in batches:
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in _texts(batch):
                words = set(WORDS.findall(fold(text)))
                stems = {w[:n] for w in words for n in range(STEM_MIN, min(len(w), STEM_MAX + 1))}
                counts[label].update(("word", w) for w in words if len(w) >= STEM_MIN)
                counts[label].update(("stem", s) for s in stems)
                counts[label]["rows", ""] += 1
            keys = list(counts[0].keys() | counts[1].keys())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], schema=fields)

    return rows.mapInArrow(run, schema).groupBy("kind", "spelling").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, fold_column=lambda c: F.lit(True), most: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon from the labelled rows whose id satisfies fold_column."""
    from echoline.llm.base import persist

    rows = persist(train_rows(docs, labels, fold_column, most), "toxicity-train")
    counts = persist(count_features(rows), "toxicity-counts")
    row = counts.where("kind = 'rows'").select("toxic", "clean").first()
    total = {"toxic": row["toxic"], "clean": row["clean"]} if row else {"toxic": 0, "clean": 0}
    lexicon = Lexicon(exceptions=list(map(fold, EXCEPTIONS)))
    if not total["toxic"] or not total["clean"]:
        return lexicon
    odds = ((F.col("toxic") + 0.5) / (total["toxic"] + 1.0)) / ((F.col("clean") + 0.5) / (total["clean"] + 1.0))
    share, n = total["toxic"] / (total["toxic"] + total["clean"]), F.col("toxic") + F.col("clean")
    lean = F.col("toxic") * F.log(F.col("toxic") / (n * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))).otherwise(0.0)
    least = math.log(max(1, counts.count())) + EVIDENCE
    kept = counts.where((F.col("kind") != "rows") & (F.col("toxic") >= LEAST_ROWS)).withColumn("odds", odds).where((F.col("odds") >= ODDS) & (lean >= least)).orderBy(F.desc("toxic"), F.length("spelling"), "spelling", "kind").limit(LEXICON_SIZE).collect()
    lexicon.words = {r["spelling"]: math.log(r["odds"]) for r in kept if r["kind"] == "word"}
    lexicon.stems = choose_stems([(r["kind"], r["spelling"], r["toxic"], math.log(r["odds"])) for r in kept])
    lexicon.exceptions += learn_exceptions(rows, lexicon)
    return calibrate(rows, lexicon)


def choose_stems(kept: list[tuple[str, str, int, float]]) -> dict[str, float]:
    """The stems to match: each as long as its family of words allows, none inside another's family.

    A longer stem or one or two whole words that account for nearly all toxic rows of a stem stand for it, so that a stem
    never reaches words of other families ("lose" gives way to the word "loser").
    """
    grown: dict[str, list[tuple[str, str, int]]] = {}
    for kind, spelling, toxic, _ in kept:
        for n in range(STEM_MIN, len(spelling) + (kind == "word")):
            grown.setdefault(spelling[:n], []).append((kind, spelling, toxic))
    out: dict[str, float] = {}
    for _, stem, toxic, weight in sorted((k for k in kept if k[0] == "stem"), key=lambda k: (len(k[1]), k[1])):
        if any(stem[:n] in out for n in range(STEM_MIN, len(stem))):
            continue
        longer = grown.get(stem, ())
        two_words = sum(sorted((n for kind, _, n in longer if kind == "word"), reverse=True)[:2])
        if max([two_words, *(n for _, _, n in longer)], default=0) < 0.9 * toxic:
            out[stem] = weight
    return out


def learn_exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases with a match that stand in clean rows only, LEAST_ROWS of them at least; the labelled rows bound
    their number."""
    bound_batches(rows.sparkSession)
    schema = "phrase string, toxic long, clean long"
    fields = spark_to_arrow(rows.sparkSession, schema)

    def run(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in _texts(batch):
                *_, folded, found = matcher.measure(text)
                phrases = set()
                for start, (_, end) in found.items():
                    if m := re.match(r"\w* \w+", folded[end + 1 : end + 60]):
                        phrases.add(folded[start : end + 1] + m[0])
                    if m := re.search(r"\w+ $", folded[max(0, start - 60) : start]):
                        phrases.add(m[0] + (WORDS.match(folded, start) or [""])[0])
                counts[label].update(phrases)
            keys = list(counts[0].keys() | counts[1].keys())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], schema=fields)

    found = rows.mapInArrow(run, schema).groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return [r["phrase"] for r in found.where((F.col("clean") >= LEAST_ROWS) & (F.col("toxic") == 0)).orderBy(F.desc("clean"), "phrase").collect()]


def calibrate(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Slope and bias of a logistic regression of the label on log(1 + x), from a histogram of x."""
    bound_batches(rows.sparkSession)
    schema = "x double, label int, n long"
    fields = spark_to_arrow(rows.sparkSession, schema)

    def run(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            seen = Counter((round(math.log1p(matcher.measure(t)[0]), 2), y) for t, y in _texts(batch))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], schema=fields)

    seen = [(r["x"], r["label"], r["n"]) for r in rows.mapInArrow(run, schema).groupBy("x", "label").agg(F.sum("n").alias("n")).orderBy("x", "label").collect()]
    if len({y for _, y, _ in seen}) < 2 or not any(x for x, _, _ in seen):
        return lexicon
    a, b, ridge = 1.0, 0.0, 0.05
    for _ in range(60):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y, n in seen:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            w = n * max(p * (1 - p), 1e-9)
            g0, g1 = g0 + n * (p - y), g1 + n * (p - y) * x
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        g0, g1, h00, h11 = g0 + ridge * b, g1 + ridge * a, h00 + ridge, h11 + ridge
        det = h00 * h11 - h01 * h01
        db, da = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a - max(-2.0, min(2.0, da)), b - max(-2.0, min(2.0, db))
        if abs(da) + abs(db) < 1e-9:
            break
    lexicon.slope, lexicon.bias = round(a, 6), round(b, 6)
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_matches, n_words) of every text."""
    from echoline.llm.base import binary_text, map_rows

    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON_SIZE entries

    def make():
        matcher = Matcher(sent.value)

        def one(doc, text):
            x, found, n_words, *_ = matcher.measure((text or b"").decode("utf-8", "replace"))
            return doc, matcher.probability(x), found, n_words

        return one

    return map_rows(binary_text(docs, id_col, text_col), make, "id long, score double, n_matches int, n_words int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below one half; all columns stay as they are. Bytes that are not valid UTF-8 are
    replaced for scoring only: the text goes to the workers as bytes, beside the row."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(lexicon)
    names, kinds = [f"c{k}" for k in range(len(docs.columns))], [f.dataType for f in docs.schema]
    as_bytes = [F.col(f"`{c}`").cast("binary").alias(n) if kind.typeName() == "string" else F.col(f"`{c}`").alias(n) for c, n, kind in zip(docs.columns, names, kinds, strict=True)]
    at = docs.columns.index(text_col)

    def run(batches):
        matcher = Matcher(sent.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([matcher.probability(matcher.measure((t or b"").decode("utf-8", "replace"))[0]) < 0.5 for t in texts], pa.bool_()))

    raw = docs.select(*as_bytes)
    return raw.mapInArrow(run, raw.schema).select(*[F.col(n).cast(kind).alias(c) for n, c, kind in zip(names, docs.columns, kinds, strict=True)])


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn on the rows whose id's checksum isn't divisible by 5, score all."""
    lexicon = learn(docs, labels, lambda c: crc_of_id(c) % 5 != 0)
    return scored(docs, lexicon).select(F.col("id").alias("doc_id"), (crc_of_id(F.col("id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches", "n_words")
