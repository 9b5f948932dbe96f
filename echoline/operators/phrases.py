"""Exact phrases: token windows and the token-aligned phrase join, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a phrase that find its places; the rest is compared there.
KEY = 4


def token_array(normalized: Column) -> Column:
    return F.when(F.coalesce(normalized, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def token_positions(df: DataFrame, normalized: str, *keys: str) -> DataFrame:
    """(keys, tok_idx, token) of each token."""
    return df.select(*keys, F.posexplode(token_array(F.col(normalized))).alias("tok_idx", "token"))


def token_windows(df: DataFrame, normalized: str, *keys: str) -> DataFrame:
    """(keys, start, len, window): the windows of n - d to n + d tokens of each text of n tokens, d being a quarter of n
    but between one and three, that fit into the text."""
    rows = df.select(*keys, token_array(F.col(normalized)).alias("t")).where(F.size("t") > 0)
    n = F.size("t")
    slack = F.greatest(F.lit(1), F.least(F.lit(3), F.ceil(n / 4).cast("int")))
    rows = rows.select(*keys, "t", F.explode(F.sequence(F.greatest(F.lit(1), n - slack), n + slack)).alias("len")).where(F.col("len") <= n)
    rows = rows.select(*keys, "t", "len", F.explode(F.sequence(F.lit(0), n - F.col("len"))).alias("start"))
    return rows.select(*keys, "start", "len", F.array_join(F.slice("t", F.col("start") + 1, F.col("len")), " ").alias("window"))


def phrase_join(media: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, media_id, tok_idx): the token positions at which a target stands in a medium.

    media: (media_id, normalized); targets: (query_id, normalized). A target is cut into pieces of KEY tokens, the last
    one flush with its end; an equi-join on whole pieces finds their places, and a target stands where all its pieces
    fall into line. A shorter target is found by its first token and compared with the KEY tokens from there. No row
    carries more than KEY tokens, so no pair of texts is compared without a reason and texts aren't copied; whether a
    side is small enough to broadcast is left to the optimizer, which knows its size.
    """
    asked = targets.select("query_id", token_array(F.col("normalized")).alias("q")).where(F.size("q") > 0)
    n, last = F.size("q"), F.size("q") - KEY
    places = F.when(n >= KEY, F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(KEY)), F.array(last))))
    pieces = asked.where(n >= KEY).select("query_id", "q", F.size(places).alias("n_pieces"), F.explode(places).alias("at"))
    pieces = pieces.select("query_id", "n_pieces", "at", F.array_join(F.slice("q", F.col("at") + 1, KEY), " ").alias("head"))
    rows = media.select("media_id", token_array(F.col("normalized")).alias("t")).where(F.size("t") > 0)
    heads = F.transform(F.sequence(F.lit(1), F.size("t")), lambda p: F.array_join(F.slice("t", p, KEY), " "))
    heads = rows.select("media_id", F.posexplode(heads).alias("pos", "head"))
    found = heads.join(pieces, "head").select("query_id", "media_id", (F.col("pos") - F.col("at")).alias("tok_idx"), "n_pieces")
    hits = found.groupBy("query_id", "media_id", "tok_idx", "n_pieces").agg(F.count(F.lit(1)).alias("n")).where("n = n_pieces")
    short = asked.where(n < KEY).select("query_id", F.get("q", F.lit(0)).alias("first"), F.concat(F.array_join("q", " "), F.lit(" ")).alias("short"))
    few = heads.select("media_id", F.col("pos").alias("tok_idx"), F.substring_index("head", " ", 1).alias("first"), F.concat("head", F.lit(" ")).alias("head"))
    few = few.join(short, "first").where(F.col("head").startswith(F.col("short")))
    return hits.select("query_id", "media_id", "tok_idx").unionByName(few.select("query_id", "media_id", "tok_idx"))


def first_phrase(media: DataFrame, targets: DataFrame, seconds_a_word: float = 0.4) -> DataFrame:
    """(query_id, media_id, tok_idx, start, n_found): the first exact place of each target in each medium."""
    hits = phrase_join(media, targets)
    return hits.groupBy("query_id", "media_id").agg(F.min("tok_idx").alias("tok_idx"), F.count(F.lit(1)).alias("n_found")).select("query_id", "media_id", "tok_idx", F.round(F.col("tok_idx") * seconds_a_word, 3).alias("start"), "n_found")
