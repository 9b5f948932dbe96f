"""Text normalisation, as column expressions where built-ins suffice and as Arrow UDFs where they don't."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoline.functions.numbers import canonical

RUNS = re.compile(r"[^\W_]+")
TOKENS = re.compile(r"[^\W_]+|\$")
DIGIT_COMMA = re.compile(r"(?<=\d),(?=\d)")
#: Text without such a character (ASCII and the letters of Latin-1 alone) is its own NFKC form, and its case folding is
#: lower() with ß as ss; JVM and Python agree on it.
UNSTABLE = "[^\\x00-\\x7FÀ-ÖØ-öø-ÿ]"


# --- plain Python, used inside the UDFs and by tests


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def normalize(text: str) -> str:
    """Folded runs of letters and digits, joined by one space."""
    return " ".join(RUNS.findall(fold(text)))


def tokens(text: str) -> list[str]:
    """Tokens for matching, with digit commas dropped and dollar signs as tokens of their own."""
    return TOKENS.findall(DIGIT_COMMA.sub("", fold(text)))


@functools.lru_cache(maxsize=1 << 16)
def word_tokens(word: str) -> tuple[str, ...]:
    """tokens() of a spoken word; frequent words are taken apart once."""
    return tuple(tokens(word))


def matching_tokens(text: str) -> list[str]:
    """Canonical tokens of a target line."""
    return [t for t, _, _ in canonical(tokens(text))]


def transcript_tokens(words: list[str]) -> list[tuple[str, int, int]]:
    """(token, first word, last word) over timed words; a number may span several words."""
    flat = [(t, k) for k, w in enumerate(words) for t in word_tokens(w or "")]
    return [(t, flat[a][1], flat[b][1]) for t, a, b in canonical([t for t, _ in flat])]


def assemble(words: list[str]) -> str:
    """The words as a reader would see them: stripped, joined, no space before punctuation."""
    return re.sub(r"\s+([.,!?;:])", r"\1", " ".join(w.strip() for w in words).strip())


# --- column expressions


def is_stable(text: Column) -> Column:
    return ~text.rlike(UNSTABLE)


def normalize_native(text: Column) -> Column:
    """normalize() for stable text, inside code generation."""
    return F.array_join(F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


@F.pandas_udf(T.StringType())
def normalize_any(text: pd.Series) -> pd.Series:
    return text.map(normalize, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalize_for_matching(text: pd.Series) -> pd.Series:
    return text.map(lambda t: " ".join(matching_tokens(t)), na_action="ignore")


def with_normalized(df, text_col: str, out: str):
    """df with `out`: stable rows stay in the JVM, only the others visit a Python worker."""
    stable = F.coalesce(is_stable(F.col(text_col)), F.lit(True))
    return df.where(stable).withColumn(out, normalize_native(F.col(text_col))).unionByName(df.where(~stable).withColumn(out, normalize_any(F.col(text_col))))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def assemble_native(words: Column) -> Column:
    """assemble() over array<struct<text>>."""
    strip = lambda w: F.regexp_replace(w, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(strip(F.array_join(F.transform(words, lambda w: strip(w["text"])), " ")), r"(?U)\s+([.,!?;:])", "$1")


def language_base(language: Column) -> Column:
    return F.split(F.replace(F.lower(language), F.lit("_"), F.lit("-")), "-")[0]


def language_matches(track: Column, requested: Column) -> Column:
    whole = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit("-"))
    return (whole(track) == whole(requested)) | (language_base(track) == language_base(requested))


def model_name(model: Column, language: Column) -> Column:
    """An English-only model falls back to `base` for other languages if it is the default one, else is an error."""
    foreign = model.endswith(".en") & language.isNotNull() & (language_base(language) != "en")
    return F.when(~F.coalesce(foreign, F.lit(False)), model).when(model == "base.en", F.lit("base")).otherwise(F.raise_error(F.concat(F.lit("English-only model for another language: "), model)))


def precision_supported(model: Column, language: Column) -> Column:
    return F.coalesce(model.endswith(".en"), F.lit(False)) | F.coalesce(language_base(language) == "en", F.lit(False))


def safe_name(language: Column) -> Column:
    return F.regexp_replace(language, r"[^\p{L}\p{N}_-]", "_")


def hms(seconds: Column) -> Column:
    """HH:MM:SS.mmm, milliseconds rounded half to even, negatives as zero."""
    ms = F.greatest(F.rint(seconds * 1000), F.lit(0.0)).cast("long")
    part = lambda unit, base: F.floor(ms / unit) % base
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), part(60000, 60), part(1000, 60), ms % 1000))


