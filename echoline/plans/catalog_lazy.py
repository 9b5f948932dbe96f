"""Queries of stored files, sought recordings, evidence in rounds and overlapping spans, each with its SQL for DuckDB.

Files are written into the shared folder from the given tables and read back by the data source. Connectors answer by a rule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.functions import rules, text
from echoline.operators import cache, intervals, lazily
from echoline.plans.catalog import MESSAGES, SQL_SECONDS, events, query, table
from echoline.plans.catalog_more import SQL_TURN_WORDS, pick, subtitle_file, turn_words
from echoline.sources import metadata, ranges, stored
from echoline.sources.connectors import Connectors, align
from echoline.tables import materialize, shared_folder


def filled(spark: SparkSession, rows: DataFrame) -> tuple[str, DataFrame]:
    """(root, what `stored.store` tells) of a new folder with the rows' files."""
    root = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    return root, materialize(stored.store(rows, root), "stored")


# --- stored files


@query(r"""
WITH f AS (SELECT unnest(['vtt', 'ass']) AS language)
SELECT conv_id AS media_id, language, CAST(row_number() OVER (PARTITION BY conv_id, language ORDER BY turn) - 1 AS INTEGER) AS cue_idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, CAST(turn * 4.0 AS DOUBLE) AS start
FROM conversations, f WHERE trim(text) <> '' AND conv_id >= 10""")
def stored_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle files of all conversations in three formats, of which the source opens two, for the media asked for only."""
    rows, files = table(spark, sf_dir, "conversations"), None
    for extension in ("vtt", "ttml", "ass"):
        one = subtitle_file(rows, extension)
        files = one if files is None else files.unionByName(one)
    root, _ = filled(spark, files.select("media_id", F.concat_ws(".", "source", "language", "extension").alias("name"), "content"))
    from echoline.sources import subtitles

    found = stored.where(spark, root, "subtitles", F.col("language").isin("vtt", "ass") & (F.col("media_id") >= 10) & (F.col("source") == "manual"))
    return subtitles.cues(found).select("media_id", "language", "cue_idx", "text", "start")


SQL_HEAD = r"lower(regexp_replace({0}, '^\s+', ''))"


@query(f"""
WITH p AS (SELECT page_id AS media_id, html, {SQL_HEAD.format('html')} AS head, octet_length(encode(html)) AS n FROM pages),
     k AS (SELECT *, starts_with(head, '<html') OR starts_with(head, '<!doctype html') AS page FROM p)
SELECT media_id, 'inspect' AS kind, n AS length, 'the metadata is no JSON' AS error FROM k
UNION ALL SELECT media_id, 'subtitles', n, CASE WHEN page THEN 'the subtitle is a web page' END FROM k
UNION ALL SELECT media_id, 'media', n, CASE WHEN page THEN 'not a media file: text/html' END FROM k
UNION ALL SELECT page_id, 'unfinished', octet_length(encode(url)), 'the download is not complete' FROM pages
UNION ALL SELECT page_id, 'empty', 0, 'the file is empty' FROM pages WHERE length(url) % 2 = 0""")
def stored_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages stored as metadata, subtitles and media, unfinished and empty files: rows with what is wrong, no exceptions."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("media_id"), "url", "html")
    name = lambda n, content="html": pages.select("media_id", F.lit(n).alias("name"), F.col(content).cast("binary").alias("content"))
    empty = pages.where(F.length("url") % 2 == 0).select("media_id", F.lit("automatic.en.srt").alias("name"), F.lit(b"").alias("content"))
    root, _ = filled(spark, name("inspect.json").unionByName(name("manual.en.vtt")).unionByName(name("direct.mp4")).unionByName(name("other.mp4.part", "url")).unionByName(empty))
    read = lambda kind: stored.read(spark, root, kind)
    unfinished = F.when(F.col("path").endswith(".part"), "unfinished").otherwise("media")
    parts = [
        read("inspect").select("media_id", F.lit("inspect").alias("kind"), "length", "error"),
        read("subtitles").select("media_id", F.when(F.col("source") == "manual", "subtitles").otherwise("empty").alias("kind"), "length", "error"),
        read("media").select("media_id", unfinished.alias("kind"), "length", "error"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""
WITH {SQL_TURN_WORDS}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY media_id ORDER BY word_idx) - 1 AS INTEGER) AS i FROM words)
SELECT media_id, i AS word_idx, text, round(start, 3) AS start, round("end", 3) AS "end" FROM o WHERE length(text) % 5 <> 4""")
def stored_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcriptions of two models as stored JSON files; the source opens those of one and leaves words without a time out."""
    w = turn_words(spark, sf_dir)
    word = F.struct("word_idx", "text", F.when(F.length("text") % 5 != 4, F.col("start")).alias("start"), "end")
    lists = w.groupBy("media_id").agg(F.array_sort(F.collect_list(word)).alias("w"))
    body = F.to_json(F.struct(F.transform("w", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"))).alias("words")))
    one = lambda model: lists.select("media_id", F.lit(f"words.{model}.json").alias("name"), body.cast("binary").alias("content"))
    root, _ = filled(spark, one("base.en").unionByName(one("tiny")))
    found = stored.where(spark, root, "words", (F.col("model") == "base.en") & F.col("error").isNull())
    return found.select("media_id", "word_idx", "text", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


# --- recordings


RATE = 20


def le32(n: Column) -> Column:
    digits = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, content): each conversation's bytes as a WAV file of RATE 8-bit samples a second."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("media_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    data = turns.select("media_id", F.array_join(F.transform("t", lambda t: t["text"]), " ").cast("binary").alias("data"))
    size = F.octet_length("data")
    head = [F.lit(b"RIFF"), le32(size + 36), F.lit(b"WAVEfmt "), le32(F.lit(16)), F.lit(b"\x01\x00\x01\x00"), le32(F.lit(RATE)), le32(F.lit(RATE)), F.lit(b"\x01\x00\x08\x00"), F.lit(b"data"), le32(size)]
    return data.select("media_id", F.concat(*head, "data").alias("content"))


@query(f"""
WITH r AS (SELECT conv_id AS media_id, hex(encode(string_agg(text, ' ' ORDER BY turn))) AS h FROM conversations GROUP BY conv_id),
     w AS (SELECT conv_id AS media_id, turn * 4.0 + 0.125 AS window_start, turn * 4.0 + 0.125 + (octet_length(encode(text)) % 50) / 16.0 AS window_end FROM conversations),
     s AS (SELECT *, length(h) // 2 AS n, least(length(h) // 2, CAST(floor(window_start * {RATE}) AS BIGINT)) AS a, CAST(ceil(window_end * {RATE}) AS BIGINT) AS z FROM w JOIN r USING (media_id)),
     c AS (SELECT *, least(n, greatest(a, z)) AS b FROM s)
SELECT media_id, CAST(window_start AS DOUBLE) AS window_start, CAST(window_end AS DOUBLE) AS window_end, substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)) AS audio, CAST(44 + b - a AS BIGINT) AS bytes_read,
       CASE WHEN n % 3 = 0 THEN 'local' ELSE 'remote' END AS origin FROM c""")
def sought_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of each turn's window, from the remote recording, or where it is gone from the local copy: headers and windows are all
    that is read."""
    sounds = materialize(recordings(spark, sf_dir), "sounds")
    copies = [sounds.select("media_id", F.lit(f"{where}.wav").alias("name"), "content", (F.octet_length("content") - 44).alias("n")) for where in ("remote", "local")]
    root, told = filled(spark, copies[0].where("n % 3 <> 0").unionByName(copies[1]))
    paths = told.groupBy("media_id").agg(F.max(F.when(F.col("name") == "remote.wav", F.col("path"))).alias("remote_path"), F.max(F.when(F.col("name") == "local.wav", F.col("path"))).alias("path"))
    begin = F.col("turn") * 4.0 + 0.125
    windows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), begin.alias("window_start"), (begin + (F.octet_length("text") % 50) / 16.0).alias("window_end"))
    gone = F.concat(F.lit(f"{root}/gone/"), F.col("media_id").cast("string"))
    found = ranges.seek(windows.join(paths, "media_id").withColumn("remote_path", F.coalesce("remote_path", gone)), "remote_path", "path")
    return found.select("media_id", "window_start", "window_end", F.hex("audio").alias("audio"), "bytes_read", "origin")


# --- evidence in rounds


SHOWS = ["view shown", "signup shown", "click shown", "error shown", "purchase shown"]
SQL_OFFERED = f"""
q AS (SELECT unnest([0, 1, 2, 3, 4]) AS query_id, unnest({SHOWS}) AS target),
f AS (SELECT event_id % 5 AS query_id, user_id AS media_id, CAST(event_id AS INTEGER) AS decode_idx, CASE WHEN value > 40 THEN event_type || ' shown' ELSE 'nothing ' || CAST(floor(value) AS INTEGER) END AS t,
             row_number() OVER (PARTITION BY event_id % 5, user_id ORDER BY event_id) AS n FROM events),
p AS (SELECT f.query_id, media_id, count(*) AS total, min(n) FILTER (t = target) AS hit, arg_min(decode_idx, n) FILTER (t = target) AS decode_idx FROM f JOIN q ON f.query_id = q.query_id GROUP BY f.query_id, media_id),
a AS (SELECT *, coalesce(hit, total) AS processed, least(total, (1 << CAST(floor(log2(coalesce(hit, total))) + 1 AS BIGINT)) - 1) AS asked FROM p)"""


def seen_in_rounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """(result, memo folder) of a search for visible text among events; an image's digest says what it shows."""

    def factory():
        return lambda row: [{"media_id": row["media_id"], "decode_idx": row["decode_idx"], "line_idx": 0, "text": row["image_digest"].removeprefix("img:"), "confidence": 0.9}]

    image = F.when(F.col("value") > 40, F.concat("event_type", F.lit(" shown"))).otherwise(F.concat(F.lit("nothing "), F.floor("value").cast("string")))
    offered = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("query_id"), F.col("user_id").alias("media_id"), F.col("event_id").cast("int").alias("decode_idx"), F.concat(F.lit("img:"), image).alias("image_digest"))
    lines = spark.createDataFrame(list(enumerate(SHOWS)), "query_id long, text string")
    memo = f"{shared_folder(spark)}/read-{uuid.uuid4().hex}"
    return lazily.first_visible(offered, lines, Connectors().register("read_text", factory), memo=memo, identity="reader"), memo


@query(f"WITH {SQL_OFFERED} SELECT query_id, media_id, decode_idx, processed, CAST(asked AS BIGINT) AS asked FROM a")
def visible_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame of each pair that shows the line, read in doubling rounds: no frame behind the round of the hit is asked about."""
    return seen_in_rounds(spark, sf_dir)[0].select("query_id", "media_id", "decode_idx", "processed", "asked")


@query(f"WITH {SQL_OFFERED} SELECT DISTINCT t AS text, CAST(1 AS BIGINT) AS reads FROM f JOIN a ON f.query_id = a.query_id AND f.media_id = a.media_id WHERE n <= asked")
def visible_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader was called for: every image of the rounds gone through once, whoever asked and how often."""
    _, memo = seen_in_rounds(spark, sf_dir)
    return cache.read(spark, memo).groupBy(F.col("value").alias("text")).agg(F.count(F.lit(1)).alias("reads"))


SQL_VARIANTS = """
t AS (SELECT page_id, page_id // 6 AS media_id, 'manual' AS source, ['en', 'de'][(page_id // 3) % 2 + 1] AS language, CAST(page_id % 6 AS INTEGER) AS track_rank, length(url) % 4 = 1 AS cached, length(html) % 3 = 0 AS good, length(html) % 19 = 7 AND length(url) % 4 <> 1 AS limited FROM pages),
o AS (SELECT *, row_number() OVER (PARTITION BY media_id, language ORDER BY cached DESC, track_rank) AS n FROM t),
g AS (SELECT *, min(n) FILTER (good AND NOT limited OR limited) OVER (PARTITION BY media_id, language) AS ends FROM o),
m AS (SELECT *, min(n) FILTER (limited AND n <= ends) OVER (PARTITION BY media_id) AS stop FROM g)"""


def variant_rounds_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    n, cached = F.col("page_id"), F.length("url") % 4 == 1
    good, limited = F.length("html") % 3 == 0, (F.length("html") % 19 == 7) & (F.length("url") % 4 != 1)
    extension = pick(["vtt", "srt", "ass"], n % 3)
    block = F.when(extension == "ass", F.lit("Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,hello")).otherwise(F.lit("WEBVTT\n\n00:00:01,000 --> 00:00:02,000\nhello"))
    content = F.when(good, block).otherwise(F.lit("<html>too many requests</html>"))
    tracks = pages.select(F.floor(n / 6).alias("media_id"), F.lit("manual").alias("source"), pick(["en", "de"], F.floor(n / 3)).alias("language"), extension.alias("extension"), (n % 6).cast("int").alias("track_rank"), cached.alias("cached"), limited.alias("limited"), content.alias("served"))

    def factory():
        return lambda row: [{"media_id": row["media_id"], "source": row["source"], "language": row["language"], "extension": row["extension"], "content": None if row["limited"] else row["served"], "rate_limited": bool(row["limited"])}]

    held = tracks.where("cached").select("media_id", "source", "language", "extension", F.col("served").alias("content"))
    return lazily.fetch_variants(tracks, Connectors().register("fetch_subtitle", factory), held)


@query(f"WITH {SQL_VARIANTS} SELECT media_id, source, language, track_rank, cached FROM m WHERE n = ends AND good AND NOT limited AND stop IS NULL")
def variant_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language the first variant that parses, fetched one after another; none of a medium that meets a rate limit."""
    return variant_rounds_of(spark, sf_dir)[0].select("media_id", "source", "language", "track_rank", "cached")


@query(f"WITH {SQL_VARIANTS} SELECT media_id, source, language, track_rank, CASE WHEN limited THEN 'rate_limited' WHEN good THEN 'parsed' ELSE 'unusable' END AS outcome FROM m WHERE n <= coalesce(ends, n) AND n <= coalesce(stop, n)")
def variant_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was fetched at all: nothing behind a variant that parses, nothing after a rate limit."""
    return variant_rounds_of(spark, sf_dir)[1].select("media_id", "source", "language", "track_rank", "outcome")


# --- overlapping spans


@query(f"""
WITH e AS (SELECT *, {SQL_SECONDS} AS sec FROM events),
     a AS (SELECT event_id AS a_id, user_id, sec AS a_low, sec + value * value * value AS a_high FROM e WHERE event_type = 'purchase'),
     b AS (SELECT event_id AS b_id, user_id, sec - value AS b_low, sec + value * 100 AS b_high FROM e WHERE event_type IN ('view', 'signup'))
SELECT user_id, a_id, b_id FROM a JOIN b USING (user_id) WHERE a_low <= b_high AND b_low <= a_high""")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlapping pairs of spans from seconds to days in length."""
    e, v = events(spark, sf_dir), F.col("value")
    a = e.where("event_type = 'purchase'").select(F.col("event_id").alias("a_id"), "user_id", F.col("at").alias("a_low"), (F.col("at") + v * v * v).alias("a_high"))
    b = e.where("event_type IN ('view', 'signup')").select(F.col("event_id").alias("b_id"), "user_id", (F.col("at") - v).alias("b_low"), (F.col("at") + v * 100).alias("b_high"))
    return intervals.overlap_join(a, b, ["user_id"], "a_low", "a_high", "b_low", "b_high").select("user_id", "a_id", "b_id")


@query(f"""
WITH {SQL_TURN_WORDS}, n AS (SELECT media_id, count(*) AS n FROM words GROUP BY media_id)
SELECT media_id, CAST(word_idx AS INTEGER) AS word_idx, round(start + CASE WHEN n % 4 = 1 THEN 0 ELSE 0.25 END, 3) AS start, CASE WHEN n % 4 = 1 THEN 'faster-whisper' ELSE 'whisperx' END AS alignment_source,
       CASE WHEN n % 4 = 1 THEN 'can''t align ' || n || ' words' END AS reason FROM words JOIN n USING (media_id)""")
def aligned_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of media whose aligner fails keep their times, with the reason; the others have the aligner's."""

    def factory():
        def one(row: dict) -> list[dict]:
            if len(row["words"]) % 4 == 1:
                raise ValueError(f"can't align {len(row['words'])} words")
            return [{"media_id": row["media_id"], "model": row["model"], "word_idx": w["word_idx"], "text": w["text"], "start": w["start"] + 0.25, "end": w["end"]} for w in row["words"]]

        return one

    words = turn_words(spark, sf_dir).withColumn("model", F.lit("base.en")).withColumn("probability", F.lit(0.9))
    out = align(words, Connectors().register("align", factory))
    return out.select("media_id", "word_idx", F.round("start", 3).alias("start"), "alignment_source", F.col("precision_fallback_reason").alias("reason"))


@query("""
WITH e AS (SELECT CAST(event_id % 97 AS VARCHAR) AS key, event_id % 3 AS writer, event_type AS value FROM events)
SELECT key, min(value) AS value, count(DISTINCT writer || value) AS n FROM e GROUP BY key""")
def memo_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writers of one memo with several values a key: the least value counts, before and after the memo is compacted; n values were
    written."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 97).cast("string").alias("key"), (F.col("event_id") % 3).alias("writer"), F.col("event_type").alias("value")).distinct()
    path = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    for writer in range(3):
        cache.write(rows.where(F.col("writer") == writer).select("key", F.lit(cache.SCHEMA_VERSION).alias("schema_version"), "value", F.lit("x").alias("namespace")), path)
    written = cache.read(spark, path).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    cache.compact(spark, path)
    return cache.usable(cache.read(spark, path), "x").join(written, "key").select("key", "value", "n")


# --- rules over tables

UNITS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()


@query("""
WITH p AS (SELECT p_partkey, lower(p_name) AS name, p_size, 1 + p_partkey % 9 AS a, 1 + p_partkey % 19 AS b FROM part)
SELECT p_partkey, name || ' costs ' || (p_size * 1000) || ' usd or ' || (a * 100 + b) || ' usd or ' || p_size || '0 5 usd' AS canonical FROM p""")
def amount_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with amounts in digits and in words, normalised for matching."""
    n = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    text_ = F.concat("p_name", F.lit(" costs $"), size, F.lit(" thousand, or "), pick(UNITS[:9], n), F.lit(" HUNDRED and "), pick(UNITS, n), F.lit(" dollars (or "), size, F.lit("0.5 usd)"))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_for_matching(text_).alias("canonical"))


@query("WITH m AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c}', '{s}', '{p}', {n})" for k, (_, c, s, p, n) in enumerate(MESSAGES)) + f""") AS t(k, code, stage, public_code, status))
SELECT page_id, code, stage, public_code, status FROM pages JOIN m ON length(html) % {len(MESSAGES)} = k""")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, stages and public answers of failures, whatever the case and the blanks around their messages."""
    message = pick([m for m, *_ in MESSAGES], F.length("html"))
    message = F.when(F.length("url") % 3 == 0, F.upper(message)).when(F.length("url") % 3 == 1, F.concat(F.lit("  Error: "), message, F.lit(" "))).otherwise(message)
    rows = table(spark, sf_dir, "pages").select("page_id", message.alias("message"))
    rows = rows.withColumn("e", rules.error_stage(F.col("message"))).withColumn("public_code", rules.public_code(F.col("message")))
    return rows.select("page_id", "e.code", "e.stage", "public_code", rules.public_status(F.col("public_code")).alias("status"))


@query("""
WITH f AS (SELECT l_orderkey AS media_id, l_linenumber AS k, CASE WHEN l_quantity % 5 <> 0 THEN CAST(l_quantity * 40 AS DOUBLE) END AS height, CASE WHEN l_tax > 0.02 THEN CAST(floor(l_extendedprice / 10000) AS DOUBLE) END AS tbr,
                  CASE WHEN l_discount > 0.01 THEN l_orderkey || '-' || l_linenumber END AS url, l_returnflag = 'R' AS silent FROM lineitem),
     r AS (SELECT media_id, url, row_number() OVER (PARTITION BY media_id ORDER BY coalesce(height, 10000) > 720, abs(coalesce(height, 720) - 720), -coalesce(tbr, 0), k) AS n FROM f WHERE url IS NOT NULL AND NOT silent)
SELECT m.media_id, r.url FROM (SELECT DISTINCT media_id FROM f) AS m LEFT JOIN r ON m.media_id = r.media_id AND r.n = 1""")
def format_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of formats of all heights and rates, some without either, the video to fetch: near 720 lines and below, then the best rate, then the
    first; formats without video or address never."""
    form = F.struct(
        F.col("l_linenumber").alias("k"), F.when(F.col("l_discount") > 0.01, F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("url"),
        F.when(F.col("l_returnflag") == "R", "none").otherwise("vp9").alias("vcodec"), F.when(F.col("l_quantity") % 5 != 0, (F.col("l_quantity") * 40).cast("double")).alias("height"),
        F.when(F.col("l_tax") > 0.02, F.floor(F.col("l_extendedprice") / 10000).cast("double")).alias("tbr"),
    )
    listed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("media_id")).agg(F.array_sort(F.collect_list(form)).alias("f"))
    meta = F.to_json(F.struct(F.lit("none").alias("vcodec"), F.transform("f", lambda x: F.struct(x["url"].alias("url"), x["vcodec"].alias("vcodec"), x["height"].alias("height"), x["tbr"].alias("tbr"))).alias("formats")))
    rows = metadata.parsed(listed.select("media_id", meta.alias("json")), "json")
    return rows.select("media_id", metadata.video_source(F.col("meta"))["url"].alias("url"))
