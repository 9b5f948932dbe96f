"""More named queries: sources, rules, selections and fuzzy matching, each with its SQL for DuckDB.

Stand-ins as in `catalog`. Fuzzy queries use the parts: a brand is a medium whose words are the names of its parts in order, and
the lines to find are part names with a letter missing or blanks moved.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoline import sinks
from echoline.functions import rules, text
from echoline.functions.similarity import compact_indel_ratio, evidence_conflicts, partial_indel_ratio
from echoline.operators import cache, captions, frames, occurrences, verify
from echoline.plans import search
from echoline.plans.catalog import SQL_SECONDS, events, query, table
from echoline.sources import metadata, subtitles, urls
from echoline.sources.connectors import Connectors, aligned, downloaded, timed_words
from echoline.tables import shared_folder


def pick(values: list, number: Column) -> Column:
    """The value at number modulo their count."""
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


# --- sources


TYPES = ["video/mp4", "audio/mpeg; codecs=x", "", "application/octet-stream", " VIDEO/WEBM ", "text/html", "application/json; x", "binary/octet-stream"]


@query(f"SELECT page_id, list_contains([0, 1, 2, 3, 4, 7], CAST(page_id % {len(TYPES)} AS INTEGER)) AS is_media FROM pages")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which content types are media: audio, video, nothing, or bytes of no type."""
    return table(spark, sf_dir, "pages").select("page_id", urls.is_media_type(pick(TYPES, F.col("page_id"))).alias("is_media"))


@query("""
WITH f AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 50 ELSE (page_id % 5) * 32 END AS rate, page_id % 7 = 0 AS bare, page_id % 11 = 0 AS mute FROM pages)
SELECT page_id AS media_id, CASE WHEN mute THEN NULL WHEN bare THEN 'both' WHEN rate >= 64 THEN 'a' ELSE 'c' END AS url FROM f""")
def audio_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audio format to fetch: without video if there is one, then the best bit rate, then the first."""
    n = F.col("page_id")
    form = lambda url, vcodec, abr, tbr: F.struct(F.lit(url).alias("url"), F.lit(vcodec).alias("vcodec"), F.when(n % 11 == 0, "none").otherwise("opus").alias("acodec"), abr.cast("double").alias("abr"), tbr.cast("double").alias("tbr"))
    zero = F.lit(0.0)
    formats = F.array(form("a", "none", (n % 5) * 32, F.lit(50)), form("both", "vp9", zero, F.lit(900)), form("c", "none", F.lit(64), zero), form("d", "none", F.lit(64), zero))
    formats = F.filter(formats, lambda f: (n % 7 != 0) | (f["vcodec"] != "none"))
    rows = metadata.parsed(table(spark, sf_dir, "pages").select(n.alias("media_id"), F.to_json(F.struct(F.lit("none").alias("acodec"), formats.alias("formats"))).alias("json")), "json")
    return rows.select("media_id", metadata.audio_source(F.col("meta"))["url"].alias("url"))


@query("""
WITH v AS (SELECT page_id, url, unnest([
  {'source': 'manual', 'language': 'en', 'extension': 'vtt', 'want': true}, {'source': 'manual', 'language': 'en', 'extension': 'srt', 'want': true},
  {'source': 'manual', 'language': 'de', 'extension': 'ttml', 'want': page_id % 2 = 0}, {'source': 'automatic', 'language': 'fr', 'extension': 'json3', 'want': page_id % 3 <> 0}]) AS t FROM pages)
SELECT page_id AS media_id, t.source AS source, t.language AS language, t.extension AS extension, url || '/' || t.extension AS url FROM v WHERE t.want""")
def caption_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption variants of provider metadata; a language whose value is no list is passed over."""
    n, url = F.col("page_id"), F.col("url")
    variant = lambda ext: F.struct(F.lit(ext).alias("ext"), F.concat(url, F.lit("/"), F.lit(ext)).alias("url"))
    listed = lambda *exts: F.to_json(F.array(*map(variant, exts)))
    german = F.when(n % 2 == 0, listed("ttml")).otherwise('"none"')
    french = F.when(n % 3 != 0, listed("json3")).otherwise('{"x":1}')
    meta = F.concat(F.lit('{"subtitles":{"en":'), listed("vtt", "srt"), F.lit(',"de":'), german, F.lit('},"automatic_captions":{"fr":'), french, F.lit("}}"))
    rows = metadata.parsed(table(spark, sf_dir, "pages").select(n.alias("media_id"), "url", meta.alias("json")), "json")
    return metadata.caption_tracks(rows).select("media_id", "source", "language", "extension", "url")


def subtitle_file(rows: DataFrame, extension: str) -> DataFrame:
    """The turns of each conversation as one file of a format."""
    stamp = lambda s: text.hms(s)
    begin, end = F.col("turn") * 4.0, F.col("turn") * 4.0 + 3.5
    body = F.regexp_replace("text", r"\s*\n\s*", "\\\\N" if extension == "ass" else "\n")
    safe = F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    block = {
        "vtt": F.concat(stamp(begin), F.lit(" --> "), stamp(end), F.lit(" align:start\n<c.x>"), safe, F.lit("</c>")),
        "ttml": F.concat(F.lit('<p begin="'), stamp(begin), F.lit('" end="'), stamp(end), F.lit('">'), F.replace(safe, F.lit("\n"), F.lit("<br/>")), F.lit("</p>")),
        "ass": F.concat(F.lit("Dialogue: 0,"), stamp(begin), F.lit(","), stamp(end), F.lit(",Default,,0,0,0,,{\\i1}"), body),
    }[extension]
    head, gap = {"vtt": ("WEBVTT\n\n", "\n\n"), "ttml": ("<tt><body><div>", ""), "ass": ("[Events]\n", "\n")}[extension]
    files = rows.withColumn("block", block).groupBy(F.col("conv_id").alias("media_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda b: b["block"]), gap).alias("body"))
    return files.select("media_id", F.lit("manual").alias("source"), F.lit(extension).alias("language"), F.lit(extension).alias("extension"), F.concat(F.lit(head), "body").alias("content"))


@query(r"""
WITH f AS (SELECT unnest(['vtt', 'ttml', 'ass']) AS language)
SELECT conv_id AS media_id, language, CAST(row_number() OVER (PARTITION BY conv_id, language ORDER BY turn) - 1 AS INTEGER) AS cue_idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, CAST(turn * 4.0 AS DOUBLE) AS start, CAST(turn * 4.0 + 3.5 AS DOUBLE) AS "end"
FROM conversations, f WHERE trim(text) <> ''""")
def subtitle_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as WebVTT, TTML and SubStation files and parsed again."""
    rows, files = table(spark, sf_dir, "conversations"), None
    for extension in ("vtt", "ttml", "ass"):
        one = subtitle_file(rows, extension)
        files = one if files is None else files.unionByName(one)
    return subtitles.cues(files).select("media_id", "language", "cue_idx", "text", "start", "end")


@query(r"""
WITH k AS (SELECT * FROM conversations WHERE turn % 4 <> 3 AND trim(text) <> '')
SELECT conv_id AS media_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS cue_idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, CAST(turn * 4.0 AS DOUBLE) AS start, CAST(turn * 4.0 + 3.5 AS DOUBLE) AS "end" FROM k""")
def subtitle_json3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as json3 files: texts in two segments, a mark before the file, events without a length or a start left out."""
    segments = F.array(F.struct(F.substring("text", 1, 7).alias("utf8")), F.struct(F.expr("substring(text, 8)").alias("utf8")))
    length = F.when(F.col("turn") % 8 == 3, F.lit("0")).when(F.col("turn") % 8 == 7, F.lit("soon")).otherwise(F.lit("3500"))
    event = F.struct("turn", F.to_json(F.struct((F.col("turn") * 4000).cast("string").alias("tStartMs"), length.alias("dDurationMs"), segments.alias("segs"))).alias("json"))
    files = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("media_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(event)), lambda e: e["json"]), ",").alias("body"))
    content = F.concat(F.lit("﻿" + '{"events":[{"segs":[{"utf8":"no start"}]},'), "body", F.lit("]}"))
    files = files.select("media_id", F.lit("automatic").alias("source"), F.lit("en").alias("language"), F.lit("json3").alias("extension"), content.alias("content"))
    return subtitles.cues(files).select("media_id", "cue_idx", "text", "start", "end")


@query("""
SELECT page_id AS media_id, page_id % 5 IN (2, 3) OR (page_id % 5 = 4 AND page_id % 2 = 0) AS usable,
       CASE WHEN page_id % 5 <> 3 THEN 'Subtitle track contains no usable entries: en' END AS message FROM pages""")
def subtitle_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads that are kept as subtitles (not pages, not empty, no JSON but json3), and those that hold no cue."""
    n = F.col("page_id")
    content = F.when(n % 5 == 0, F.col("html")).when(n % 5 == 1, F.lit("")).when(n % 5 == 2, F.lit("WEBVTT\n\nno times here")).when(n % 5 == 3, F.lit("WEBVTT\n\n00:01.000 --> 00:02.000\nhello")).otherwise(F.lit('[{"error": 1}]'))
    extension = F.when((n % 5 == 4) & (n % 2 == 0), "json3").otherwise("vtt")
    files = table(spark, sf_dir, "pages").select(n.alias("media_id"), F.lit("manual").alias("source"), F.lit("en").alias("language"), extension.alias("extension"), content.alias("content"))
    bad = subtitles.unusable(files, subtitles.cues(files)).select("media_id", "message")
    return files.select("media_id", subtitles.is_usable(F.col("content"), F.col("extension")).alias("usable")).join(bad, "media_id", "left")


@query("""
WITH t AS (SELECT page_id // 6 AS media_id, 'manual' AS source, ['en', 'de'][(page_id // 3) % 2 + 1] AS language, CAST(page_id % 6 AS INTEGER) AS track_rank, page_id % 4 = 1 AS cached, page_id % 5 IN (0, 3) AS parsed, page_id % 29 = 7 AS rate_limited FROM pages),
     o AS (SELECT *, row_number() OVER (PARTITION BY media_id, source, language ORDER BY cached DESC, track_rank) AS n FROM t),
     u AS (SELECT *, min(n) FILTER (parsed) OVER (PARTITION BY media_id, source, language) AS first_usable FROM o),
     l AS (SELECT *, bool_or(rate_limited AND (first_usable IS NULL OR n < first_usable)) OVER (PARTITION BY media_id) AS limited FROM u)
SELECT media_id, source, language, track_rank, cached FROM l WHERE n = first_usable AND NOT limited""")
def caption_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language the variant to read: cached ones first, then the first that parses; a rate limit ends a medium's search."""
    n = F.col("page_id")
    tracks = table(spark, sf_dir, "pages").select(F.floor(n / 6).alias("media_id"), F.lit("manual").alias("source"), pick(["en", "de"], F.floor(n / 3)).alias("language"), (n % 6).cast("int").alias("track_rank"), (n % 4 == 1).alias("cached"), (n % 5).isin(0, 3).alias("parsed"), (n % 29 == 7).alias("rate_limited"))
    return captions.first_parsed(tracks).select("media_id", "source", "language", "track_rank", "cached")


@query("""
SELECT conv_id AS media_id, CAST(turn AS INTEGER) AS word_idx, turn * 4.0 + CASE WHEN turn % 2 = 0 AND turn % 6 <> 0 THEN 0.25 ELSE 0 END AS start,
       turn * 4.0 + 3.5 - CASE WHEN turn % 2 = 0 AND turn % 6 <> 0 THEN 0.25 ELSE 0 END AS "end",
       CASE WHEN turn % 2 = 0 AND turn % 6 <> 0 THEN 'whisperx' ELSE 'faster-whisper' END AS alignment_source FROM conversations WHERE turn % 5 <> 4""".replace("turn * 4.0", "CAST(turn * 4.0 AS DOUBLE)").replace("THEN 0.25 ELSE 0 END", "THEN CAST(0.25 AS DOUBLE) ELSE 0 END").replace("+ 3.5", "+ CAST(3.5 AS DOUBLE)"))
def aligned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the aligner's times where it gave both, their own otherwise; words without times can't be placed."""
    t = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.lit("base.en").alias("model"), t.cast("int").alias("word_idx"), "text", F.when(t % 5 != 4, t * 4.0).alias("start"), (t * 4.0 + 3.5).alias("end"), F.lit(0.9).alias("probability"))
    new = rows.where("word_idx % 2 = 0").select("media_id", "model", "word_idx", (F.col("start") + 0.25).alias("start"), F.when(F.col("word_idx") % 6 != 0, F.col("end") - 0.25).alias("end"))
    return aligned(timed_words(rows), new).select("media_id", "word_idx", "start", "end", "alignment_source")


@query("SELECT user_id AS media_id, min(event_id) AS decode_idx, arg_min(value, event_id) AS timestamp FROM events GROUP BY user_id")
def sample_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first decodable frame of each medium."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("decode_idx"), F.col("value").alias("timestamp"))
    return frames.sample_frame(rows).select("media_id", "decode_idx", "timestamp")


ENDINGS = [".mp4", ".mp4.part", ".webm.ytdl", ".part-Frag1", ".MP4.TMP", ".aria2", ".mkv", ".temp"]


@query("SELECT page_id, page_id % 8 IN (0, 6) AND page_id % 3 > 0 AS complete FROM pages")
def complete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored files are finished downloads."""
    n = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", urls.is_complete(F.concat(F.lit("/cache/"), n.cast("string"), pick(ENDINGS, n)), n % 3).alias("complete"))


@query("""
WITH u AS (SELECT page_id, url || '#' || page_id AS url FROM pages)
SELECT page_id AS media_id, url, CASE WHEN page_id % 4 = 0 AND page_id % 12 <> 0 THEN '/cache/x' || page_id || '.mp4' WHEN page_id % 4 = 1 THEN '/cache/direct-' || substr(sha256(url), 1, 16) || CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '^[^:]+://[^/]*/(.*/)?[^/]+\\.[A-Za-z0-9]{1,9}$') THEN lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[A-Za-z0-9]{1,9})$', 1)) ELSE '.media' END END AS path,
       CASE WHEN page_id % 4 = 0 AND page_id % 12 <> 0 THEN 'index' WHEN page_id % 4 = 1 THEN 'direct' END AS origin FROM u""")
def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a URL's medium is stored: by the index (inside its folder only), else by the name of a direct download."""
    asked = table(spark, sf_dir, "pages").select(F.col("page_id").alias("media_id"), F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"))
    n, name = F.col("media_id"), F.concat(F.lit("x"), F.col("media_id").cast("string"), F.lit(".mp4"))
    index = asked.where(n % 4 == 0).select(urls.cache_key(F.col("url")).alias("key"), F.concat(F.when(n % 12 == 0, "/cache/../etc/").otherwise("/cache/"), name).alias("path"))
    stored = index.select("path").unionByName(asked.where(n % 4 == 1).select(F.concat(F.lit("/cache/"), urls.file_name(F.col("url"))).alias("path")))
    unfinished = asked.where(n % 4 == 2).select(F.concat(F.lit("/cache/"), urls.file_name(F.col("url")), F.lit(".part")).alias("path"))
    files = stored.unionByName(unfinished).select("path", F.lit(10).cast("long").alias("length"), F.lit(0).cast("long").alias("modified"))
    return urls.stored_media(asked, index, files, "/cache")


@query("SELECT page_id AS media_id, CAST(page_id % 90 AS DOUBLE) AS duration, page_id % 2 = 0 AS has_video, page_id % 3 = 0 AS has_audio, CASE WHEN page_id % 2 <> 0 THEN 'Media does not contain a video stream.' WHEN page_id % 3 <> 0 THEN 'Media does not contain an audio stream.' END AS error, CASE WHEN page_id % 3 <> 0 THEN 'Media does not contain an audio stream.' END AS audio_error FROM pages")
def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media probed by a registered connector; what a search needs and they lack."""

    def factory():
        def probe(row: dict) -> list[dict]:
            kinds = ["video"] * (row["media_id"] % 2 == 0) + ["audio"] * (row["media_id"] % 3 == 0)
            return [{"media_id": row["media_id"], "probe": json.dumps({"format": {"duration": str(row["media_id"] % 90)}, "streams": [{"index": k, "codec_type": x} for k, x in enumerate(kinds)]})}]

        return probe

    probed = Connectors().register("probe", factory).run("probe", table(spark, sf_dir, "pages").select(F.col("page_id").alias("media_id")))
    media = metadata.media_info(probed, "probe")
    return media.select("media_id", "duration", "has_video", "has_audio", rules.stream_error(F.col("has_video"), F.col("has_audio")).alias("error"), rules.stream_error(F.col("has_video"), F.col("has_audio"), True).alias("audio_error"))


# --- memo tables and reports


@query("""
WITH e AS (SELECT event_id, value, 'k' || event_id AS key FROM events)
SELECT event_id, key, event_id % 5 NOT IN (2, 3) AND event_id % 2 = 0 AS hit, CASE WHEN event_id % 5 NOT IN (2, 3) AND event_id % 2 = 0 THEN event_id END AS stored FROM e""")
def memo_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memo rows of another version, another namespace or without a value are misses."""
    n = F.col("event_id")
    asked = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("k"), n.cast("string")).alias("key"))
    memo = cache.envelope(asked.where(n % 2 == 0), "key", ["event_id"], "media_info").withColumn("id", F.substring("key", 2, 12).cast("long"))
    memo = memo.withColumn("schema_version", F.when(F.col("id") % 5 == 2, 0).otherwise(F.col("schema_version"))).withColumn("value", F.when(F.col("id") % 5 != 3, F.col("value")))
    other = cache.envelope(asked.where(n % 2 == 1), "key", ["event_id"], "ocr")
    hits, misses = cache.hits_and_misses(asked, memo.drop("id").unionByName(other), "key", "media_info")
    stored = F.get_json_object("value", "$.event_id").cast("long")
    return hits.select("event_id", "key", F.lit(True).alias("hit"), stored.alias("stored")).unionByName(misses.select("event_id", "key", F.lit(False).alias("hit"), F.lit(None).cast("long").alias("stored")))


PACKAGES = {"whisper": "1.1", "ctranslate": "4.0"}


@query("SELECT doc_id, 'base.en|ctranslate=4.0|whisper=1.1|int8|auto|auto' || '|' || sha256(coalesce(text, '')) AS identity FROM documents")
def cache_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity that a memo key is made of: model, package versions, compute type, language, mode, content."""
    who = cache.identity("base.en", PACKAGES, "int8", None, "auto")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", F.lit(who), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("identity"))


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results made of events."""
    n = F.col("event_id")
    return events(spark, sf_dir).select(n.alias("query_id"), F.col("user_id").alias("media_id"), F.col("event_type").alias("matched_text"), F.col("at").alias("start"), (F.col("at") + 2.5).alias("end"), F.when(n % 2 == 0, "exact").otherwise("fuzzy").alias("match_type"), F.col("value").alias("score"), F.when(n % 3 != 0, n % 3).cast("int").alias("occurrence_count"), F.when(n % 5 == 0, True).alias("evidence_conflict"))


SQL_HMS = "printf('%02d:%02d:%02d.%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"


@query(f"""
WITH e AS (SELECT *, {SQL_SECONDS} AS sec FROM events), m AS (SELECT *, CAST(round_even(sec * 1000, 0) AS BIGINT) AS a, CAST(round_even((sec + 2.5) * 1000, 0) AS BIGINT) AS b FROM e)
SELECT event_id AS query_id, user_id AS media_id, 'line ' || event_id AS query, event_type AS matched_text, {SQL_HMS.format('a')} AS dialogue_start_hms, {SQL_HMS.format('b')} AS dialogue_end_hms,
       CASE event_id % 2 WHEN 0 THEN 'exact' ELSE 'fuzzy' END AS match_type, value AS match_score, CAST(CASE WHEN event_id % 3 = 2 THEN 2 ELSE 1 END AS INTEGER) AS occurrence_count, event_id % 5 = 0 AS evidence_conflict, false AS precision_fallback_used, 'tiny.en' AS asr_model_used, 'auto' AS precision_mode, CAST(45.0 AS DOUBLE) AS precision_trigger_threshold FROM m""")
def flat_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat report: times as text too, at least one occurrence, provenance of the run."""
    results = event_results(spark, sf_dir)
    asked = results.select("query_id", F.concat(F.lit("line "), F.col("query_id").cast("string")).alias("text"))
    rows = sinks.report(results, asked, provenance=sinks.Provenance(asr_model="tiny.en"))
    return rows.select("query_id", "media_id", "query", "matched_text", "dialogue_start_hms", "dialogue_end_hms", "match_type", "match_score", "occurrence_count", "evidence_conflict", "precision_fallback_used", "asr_model_used", "precision_mode", F.col("precision_trigger_threshold").cast("double").alias("precision_trigger_threshold"))


@query("SELECT event_id AS query_id, user_id AS media_id, event_type AS matched_text, event_id % 5 = 0 AS conflict, CAST(CASE WHEN event_id % 3 = 2 THEN 2 ELSE 1 END AS INTEGER) AS n FROM events")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as JSON objects, read back."""
    results = event_results(spark, sf_dir)
    rows = sinks.as_json(sinks.report(results, results.select("query_id", F.lit("x").alias("text"))))
    at = lambda path, kind: F.get_json_object("json", f"$.{path}").cast(kind)
    return rows.select("query_id", "media_id", at("matched_text", "string").alias("matched_text"), at("evidence_conflict", "boolean").alias("conflict"), at("occurrence_count", "int").alias("n"))


@query("""
WITH g AS (SELECT event_id, user_id, substr(sha256(user_id || '|' || event_id % 40 || '|' || sha256('img' || user_id || '-' || event_id % 40)), 1, 32) AS frame_id FROM events WHERE event_type = 'purchase')
SELECT DISTINCT frame_id, user_id AS media_id, CAST(event_id % 40 AS INTEGER) AS frame_index FROM g""")
def frame_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of the chosen frames under opaque ids, each once."""
    e = table(spark, sf_dir, "events")
    chosen = e.where("event_type = 'purchase'").select(F.col("user_id").alias("media_id"), (F.col("event_id") % 40).cast("int").alias("frame_index"))
    images = e.select(F.col("user_id").alias("media_id"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("decode_idx")).distinct()
    images = images.withColumn("image", F.concat(F.lit("img"), F.col("media_id").cast("string"), F.lit("-"), F.col("decode_idx").cast("string")).cast("binary"))
    return sinks.frame_images(chosen, images).select("frame_id", "media_id", "frame_index")


# --- text rules


@query(r"""
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, w[1] || ', ' || w[2] || '! - ' || w[1] || '?' AS text FROM p""")
def assembled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken words as a reader would see them: stripped, joined, no space before punctuation."""
    w = F.split("p_name", " ")
    words = F.array(F.concat(F.lit("  "), w[0]), F.lit(", "), F.concat(F.lit("\t"), w[1], F.lit(" ")), F.lit("!"), F.lit(" -"), F.concat(w[0], F.lit("\n?  ")))
    return table(spark, sf_dir, "part").select("p_partkey", text.assemble_native(F.transform(words, lambda x: F.struct(x.alias("text")))).alias("text"))


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) || '_XX' ELSE lang END AS language, CASE WHEN doc_id % 2 = 0 THEN 'base.en' WHEN doc_id % 3 = 0 AND lang = 'en' THEN 'tiny.en' ELSE 'small' END AS model FROM documents)
SELECT doc_id, CASE WHEN model = 'base.en' AND lower(substr(language, 1, 2)) <> 'en' THEN 'base' ELSE model END AS model, ends_with(model, '.en') OR coalesce(lower(substr(language, 1, 2)) = 'en', false) AS precise, language AS safe FROM d""")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model for a language, whether a precise second pass is possible, and the language as part of a file name."""
    n, lang = F.col("doc_id"), F.col("lang")
    language = F.when(n % 3 == 0, F.concat(F.upper(lang), F.lit("_XX"))).otherwise(lang)
    model = F.when(n % 2 == 0, "base.en").when((n % 3 == 0) & (lang == "en"), "tiny.en").otherwise("small")
    return table(spark, sf_dir, "documents").select("doc_id", text.model_name(model, language).alias("model"), text.precision_supported(model, language).alias("precise"), text.safe_name(F.regexp_replace(language, "_", "_")).alias("safe"))


@query(r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g') AS name FROM pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


SCALES = {"thousand": 1000, "million": 1000000, "billion": 1000000000, "": 1}


@query("""
WITH e AS (SELECT event_id, event_id % 97 + 1 AS n, CAST(event_id % 4 AS INTEGER) AS k FROM events),
     s AS (SELECT event_id, n * [1000, 1000000, 1000000000, 1][k + 1] AS v, CASE WHEN k = 3 THEN 0 ELSE 1 END AS extra FROM e),
     t AS (SELECT event_id, unnest([{'i': 0, 'token': 'it', 'a': 0, 'b': 0}, {'i': 1, 'token': 'cost', 'a': 1, 'b': 1}, {'i': 2, 'token': CAST(v AS VARCHAR), 'a': 2, 'b': 3 + extra}, {'i': 3, 'token': 'usd', 'a': 2, 'b': 3 + extra}, {'i': 4, 'token': 'ok', 'a': 4 + extra, 'b': 4 + extra}]) AS x FROM s)
SELECT event_id AS media_id, CAST(x.i AS INTEGER) AS tok_idx, x.token AS token, CAST(x.a AS INTEGER) AS first_word, CAST(x.b AS INTEGER) AS last_word FROM t""")
def number_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical tokens of spoken amounts, each with the words that it was made of."""
    n = F.col("event_id")
    scale = pick(list(SCALES), n)
    words = F.filter(F.array(F.lit(" It"), F.lit(" cost"), (n % 97 + 1).cast("string"), scale, F.lit("dollars,"), F.lit("ok.")), lambda w: w != "")
    timed = F.transform(words, lambda w: F.struct(w.alias("text"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end")))
    rows = occurrences.spread(table(spark, sf_dir, "events").select("event_id"))
    return occurrences.token_spans(rows.select(n.alias("media_id"), timed.alias("words")))


@query(r"""
WITH t AS (SELECT conv_id * 4294967296 + turn AS query_id, CASE turn % 4 WHEN 0 THEN '... !' WHEN 1 THEN '$ 5' WHEN 2 THEN '' ELSE text END AS text FROM conversations),
     d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '?! -- ...' WHEN 1 THEN NULL ELSE text END AS text FROM documents)
SELECT query_id, CAST(NULL AS BIGINT) AS media_id, 'Target dialogue must contain at least one letter or number.' AS message FROM t WHERE NOT regexp_matches(text, '[\p{L}\p{N}]|\$\s*\p{Nd}')
UNION ALL SELECT NULL, doc_id, 'Transcription contains no matchable words.' FROM d WHERE NOT regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]|\$\s*\p{Nd}')""")
def matching_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and transcripts that can't match, as rows."""
    t, d = F.col("turn") % 4, F.col("doc_id") % 5
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * (1 << 32) + F.col("turn")).alias("query_id"), F.when(t == 0, "... !").when(t == 1, "$ 5").when(t == 2, "").otherwise(F.col("text")).alias("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(d == 0, F.lit("?! -- ...")).when(d != 1, F.col("text")).alias("text"))
    return occurrences.errors(asked, occurrences.spoken(docs, "doc_id", "text"))


# --- windows and selections


@query(f"""
WITH e AS (SELECT *, {SQL_SECONDS} AS sec FROM events),
     c AS (SELECT user_id AS media_id, event_id % 3 AS query_id, CAST(row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS INTEGER) AS rank, value AS start, value + event_id % 4 AS "end" FROM e WHERE event_type = 'purchase'),
     m AS (SELECT user_id AS media_id, max(value) / 2 AS duration FROM e GROUP BY user_id),
     w AS (SELECT c.*, i AS margin_idx, greatest(0.0, c.start - [2.0, 5.0, 2.0][i + 1]) AS window_start, least(m.duration, c."end" + [2.0, 5.0, 2.0][i + 1]) AS window_end FROM c LEFT JOIN m USING (media_id), (SELECT unnest([0, 1, 2]) AS i)),
     o AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id, CAST(round_even(window_start * 1000, 0) AS BIGINT), CAST(round_even(window_end * 1000, 0) AS BIGINT) ORDER BY rank, margin_idx) AS n FROM w WHERE window_end > window_start)
SELECT query_id, media_id, CAST(row_number() OVER (PARTITION BY query_id, media_id ORDER BY rank, margin_idx) AS INTEGER) AS window_rank, rank, round(window_start, 6) AS window_start, round(window_end, 6) AS window_end FROM o WHERE n = 1""")
def attempt_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around candidates, clamped to the medium, empty ones and repeats left out."""
    e = events(spark, sf_dir)
    key = F.col("event_id") % 3
    order = Window.partitionBy("user_id", key).orderBy("event_id")
    found = e.where("event_type = 'purchase'").select(F.col("user_id").alias("media_id"), key.alias("query_id"), F.row_number().over(order).alias("rank"), F.col("value").alias("start"), (F.col("value") + F.col("event_id") % 4).alias("end"))
    media = e.groupBy(F.col("user_id").alias("media_id")).agg((F.max("value") / 2).alias("duration")).withColumn("audio_start_time", F.lit(0.0))
    rows = verify.attempt_windows(found, media, (2.0, 5.0, 2.0))
    return rows.select("query_id", "media_id", "window_rank", "rank", F.round("window_start", 6).alias("window_start"), F.round("window_end", 6).alias("window_end"))


@query(f"""
WITH e AS (SELECT *, {SQL_SECONDS} AS sec FROM events),
     s AS (SELECT event_id AS query_id, user_id AS media_id, sec - 40000.0 AS lo, sec + 40000.0 AS hi FROM e WHERE event_type = 'purchase'),
     w AS (SELECT user_id AS media_id, event_id AS word_idx, event_type AS text, sec AS start, sec + 1.5 AS "end" FROM e)
SELECT s.query_id, s.media_id, CAST(count(w.word_idx) AS INTEGER) AS n, coalesce(string_agg(w.text, ' ' ORDER BY w.word_idx), '') AS spoken FROM s LEFT JOIN w ON s.media_id = w.media_id AND w.start >= s.lo AND w."end" <= s.hi GROUP BY s.query_id, s.media_id""")
def audio_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words spoken wholly inside each window: a range scan instead of an extracted recording."""
    e = events(spark, sf_dir)
    windows = e.where("event_type = 'purchase'").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("media_id"), F.lit(1).alias("window_rank"), (F.col("at") - 40000.0).alias("window_start"), (F.col("at") + 40000.0).alias("window_end"))
    words = e.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("word_idx"), F.col("event_type").alias("text"), F.col("at").alias("start"), (F.col("at") + 1.5).alias("end"))
    rows = verify.words_in_windows(windows, words, bucket=80000.0)
    return rows.select("query_id", "media_id", F.size("words").alias("n"), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("spoken"))


@query("""
WITH c AS (SELECT conv_id AS media_id, turn AS seq, CAST((turn // 2) * 4.0 AS DOUBLE) AS start, CAST((turn // 2) * 4.0 + 4.0 AS DOUBLE) AS "end", CASE length(text) % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'substring' ELSE 'fuzzy' END AS match_type, CAST(85 + length(text) % 16 AS DOUBLE) AS score FROM conversations),
     g AS (SELECT *, 0 AS g FROM c WHERE seq % 3 <> 0 UNION ALL SELECT * REPLACE (100.0 AS score), 1 FROM c WHERE seq % 2 = 0),
     p AS (SELECT *, CASE match_type WHEN 'exact' THEN 0 WHEN 'substring' THEN 1 ELSE 2 END AS prio FROM g),
     b AS (SELECT *, row_number() OVER (PARTITION BY media_id, start, "end" ORDER BY prio, score DESC, g, seq) AS n FROM p)
SELECT media_id, 1 AS query_id, CAST(seq AS INTEGER) AS seq, start, "end", match_type, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start, prio, "end", score DESC, g, seq) AS INTEGER) AS rank FROM b WHERE n = 1""")
def caption_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of candidates as one ranked list without repeats; the earlier group wins ties."""
    rows = table(spark, sf_dir, "conversations")
    kind = F.when(F.length("text") % 3 == 0, "exact").when(F.length("text") % 3 == 1, "substring").otherwise("fuzzy")
    begin = F.floor(F.col("turn") / 2).cast("double") * 4.0
    found = rows.select(F.col("conv_id").alias("media_id"), F.lit(1).alias("query_id"), F.col("turn").cast("int").alias("seq"), begin.alias("start"), (begin + 4.0).alias("end"), kind.alias("match_type"), (85 + F.length("text") % 16).cast("double").alias("score"))
    return captions.merged(found.where("seq % 3 <> 0"), found.where("seq % 2 = 0").withColumn("score", F.lit(100.0)))


@query("""
WITH f AS (SELECT event_id % 7 AS query_id, user_id AS media_id, CAST(row_number() OVER (PARTITION BY event_id % 7, user_id ORDER BY event_id) - 1 AS INTEGER) AS occ_idx, event_type AS matched_text, value + user_id % 3 AS start, 'exact' AS match_type FROM events)
SELECT query_id, media_id, arg_min(matched_text, occ_idx) AS matched_text, round(arg_min(start, occ_idx), 6) AS start, CAST(count(*) AS INTEGER) AS occurrence_count, string_agg(matched_text, ',' ORDER BY occ_idx) AS all_texts FROM f GROUP BY query_id, media_id""")
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the occurrences of each query in each medium, how many there are, times moved by the audio's start."""
    key = F.col("event_id") % 7
    order = Window.partitionBy(key, "user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events")
    found = rows.select(key.alias("query_id"), F.col("user_id").alias("media_id"), (F.row_number().over(order) - 1).alias("occ_idx"), F.col("event_type").alias("matched_text"), F.col("value").alias("start"), (F.col("value") + 1).alias("end"), F.lit("exact").alias("match_type"), F.lit(100.0).alias("score"))
    media = rows.select(F.col("user_id").alias("media_id")).distinct().withColumn("audio_start_time", F.when(F.col("media_id") % 3 != 0, (F.col("media_id") % 3).cast("double")))
    out = search.first_of(found, media)
    return out.select("query_id", "media_id", "matched_text", F.round("start", 6).alias("start"), "occurrence_count", F.array_join(F.transform("occurrences", lambda o: o["matched_text"]), ",").alias("all_texts"))


@query("""
WITH o AS (SELECT event_id % 5 AS query_id, user_id AS media_id, CAST(event_id AS INTEGER) AS decode_idx, value FROM events),
     h AS (SELECT query_id, media_id, min(decode_idx) AS first FROM o WHERE value > 60 GROUP BY query_id, media_id)
SELECT o.query_id, o.media_id, any_value(h.first) AS decode_idx, CAST(count(*) FILTER (h.first IS NULL OR o.decode_idx <= h.first) AS BIGINT) AS processed FROM o LEFT JOIN h ON o.query_id = h.query_id AND o.media_id = h.media_id GROUP BY o.query_id, o.media_id""")
def first_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame offered to a query that shows its line, and how many frames were looked at."""
    offered = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("query_id"), F.col("user_id").alias("media_id"), F.col("event_id").cast("int").alias("decode_idx"), "value")
    shown = offered.where("value > 60").select("query_id", "media_id", "decode_idx", F.lit("x").alias("matched_text"), F.lit("exact").alias("match_type"), F.lit(100.0).alias("score"))
    return frames.first_visible(offered.drop("value"), shown).select("query_id", "media_id", "decode_idx", "processed")


# --- fuzzy matching

#: LCS of all pairs of a table `pairs` (a, b), by rows of the dynamic programme, as `lcs` (a, b, common).
SQL_LCS = """
r AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda k: CAST(0 AS INTEGER)) AS row FROM pairs
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN 0 ELSE greatest(row[k + 1], row[k] + CAST(substr(a, i + 1, 1) = substr(b, k, 1) AS INTEGER)) END)))
  FROM r WHERE i < length(a)
),
lcs AS (SELECT a, b, row[length(b) + 1] AS common FROM r WHERE i = length(a))"""


@query(f"""
WITH RECURSIVE n AS (SELECT x.p_partkey, lower(x.p_name) AS a, lower(x.p_type || ' ' || y.p_name) AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1),
pairs AS (SELECT DISTINCT a, b FROM n UNION SELECT DISTINCT replace(a, ' ', ''), replace(b, ' ', '') FROM n), {SQL_LCS}
SELECT p_partkey, round(CAST(greatest(200.0 * s.common / (length(n.a) + length(n.b)), 200.0 * c.common / (length(c.a) + length(c.b))) AS DOUBLE), 6) AS score
FROM n JOIN lcs s ON s.a = n.a AND s.b = n.b JOIN lcs c ON c.a = replace(n.a, ' ', '') AND c.b = replace(n.b, ' ', '')""")
def compact_ratio_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against the next one's type and name, with blanks or without, whichever is nearer."""
    parts = table(spark, sf_dir, "part")
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    rows = parts.join(after, "p_partkey").select("p_partkey", F.lower("p_name").alias("a"), F.lower(F.concat_ws(" ", "p_type", "next")).alias("b"))
    return rows.select("p_partkey", F.round(compact_indel_ratio("a", "b"), 6).alias("score"))


@query(f"""
WITH RECURSIVE n AS (SELECT x.p_partkey, lower(x.p_name) AS a, lower(y.p_name || ' ' || z.p_name) AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1 JOIN part z ON z.p_partkey = x.p_partkey + 2),
d AS (SELECT DISTINCT CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM n),
ways AS (SELECT s, l, s AS p, l AS t FROM d UNION SELECT s, l, l, s FROM d WHERE length(s) = length(l)),
w AS (SELECT DISTINCT s, l, p AS a, substr(t, greatest(1, CAST(k AS INTEGER)), CAST(least(length(t), k + length(p) - 1) - greatest(1, k) + 1 AS INTEGER)) AS b FROM (SELECT *, unnest(range(2 - length(p), length(t) + 1)) AS k FROM ways)),
pairs AS (SELECT DISTINCT a, b FROM w), {SQL_LCS},
best AS (SELECT s, l, max(200.0 * common / (length(w.a) + length(w.b))) AS score FROM w JOIN lcs ON lcs.a = w.a AND lcs.b = w.b GROUP BY s, l)
SELECT p_partkey, round(CAST(score AS DOUBLE), 6) AS partial_score, score < 85 AS conflict FROM n JOIN best ON s = CASE WHEN length(a) <= length(b) THEN a ELSE b END AND l = CASE WHEN length(a) <= length(b) THEN b ELSE a END""")
def partial_ratio_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against its best place in the next two names, and whether the two conflict as evidence."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"))
    shifted = lambda k, name: parts.select((F.col("p_partkey") - k).alias("p_partkey"), F.col("a").alias(name))
    rows = parts.join(shifted(1, "b1"), "p_partkey").join(shifted(2, "b2"), "p_partkey").select("p_partkey", "a", F.concat_ws(" ", "b1", "b2").alias("b"))
    return rows.select("p_partkey", F.round(partial_indel_ratio("a", "b"), 6).alias("partial_score"), evidence_conflicts(F.col("a"), F.col("b"), 85.0).alias("conflict"))


def brand_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, words): each brand's part names as a transcript of words of 0.4 seconds."""
    parts = table(spark, sf_dir, "part").select(F.expr("substring(p_brand, 7)").cast("long").alias("media_id"), "p_partkey", "p_name")
    lines = parts.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " ").alias("text"))
    return occurrences.spoken(lines, "media_id", "text")


def name_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text): every part name without its last letter, named by its first part."""
    parts = table(spark, sf_dir, "part")
    return parts.groupBy(F.expr("substring(p_name, 1, length(p_name) - 1)").alias("text")).agg(F.min("p_partkey").alias("query_id")).select("query_id", "text")


SQL_WINDOWS = """
m AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS media_id, string_split(string_agg(p_name, ' ' ORDER BY p_partkey), ' ') AS t FROM part GROUP BY 1),
q AS (SELECT min(p_partkey) AS query_id, substr(p_name, 1, length(p_name) - 1) AS q FROM part GROUP BY 2),
w AS (SELECT media_id, s, n, array_to_string(t[s + 1:s + n], ' ') AS w FROM (SELECT *, unnest(range(0, len(t))) AS s FROM m), (SELECT unnest([1, 2, 3]) AS n) WHERE s + n <= len(t)),
pairs AS (SELECT q AS a, w AS b FROM q, (SELECT DISTINCT w FROM w) WHERE {0})"""


@query(f"""
WITH RECURSIVE {SQL_WINDOWS.format('200.0 * least(length(q), length(w)) >= 85 * (length(q) + length(w))')}, {SQL_LCS},
good AS (SELECT a, b, 200.0 * common / (length(a) + length(b)) AS score FROM lcs WHERE 200.0 * common >= 85.0 * (length(a) + length(b))),
v AS (SELECT query_id, media_id, s, n, w, score FROM good JOIN q ON q.q = a JOIN w ON w.w = b),
anchor AS (SELECT query_id, media_id, s, arg_max(n, (score, -n)) AS n FROM v GROUP BY query_id, media_id, s),
chosen AS (
  SELECT a.query_id, a.media_id, a.s AS anchor, arg_max({{'s': v.s, 'n': v.n, 'w': v.w, 'score': v.score}}, (v.score, -abs(v.n - 2), -v.s, -v.n)) AS c
  FROM anchor a JOIN v ON v.query_id = a.query_id AND v.media_id = a.media_id AND ((v.s = a.s AND v.n = a.n) OR (v.s > a.s AND v.s < a.s + a.n)) GROUP BY a.query_id, a.media_id, a.s
),
hop AS (SELECT x.query_id, x.media_id, x.anchor, any_value(x.c) AS c, min(y.anchor) AS next FROM chosen x LEFT JOIN chosen y ON y.query_id = x.query_id AND y.media_id = x.media_id AND y.anchor >= x.c.s + x.c.n GROUP BY x.query_id, x.media_id, x.anchor),
walk AS (
  SELECT query_id, media_id, 0 AS occ_idx, min(anchor) AS anchor FROM hop GROUP BY query_id, media_id
  UNION ALL
  SELECT h.query_id, h.media_id, occ_idx + 1, h.next FROM walk k JOIN hop h ON h.query_id = k.query_id AND h.media_id = k.media_id AND h.anchor = k.anchor WHERE h.next IS NOT NULL
)
SELECT k.query_id, k.media_id, CAST(occ_idx AS INTEGER) AS occ_idx, c.w AS matched_text, round(CAST(c.s * 0.4 AS DOUBLE), 3) AS start, round(CAST((c.s + c.n) * 0.4 AS DOUBLE), 3) AS "end", CASE WHEN c.score = 100 THEN 'exact' ELSE 'fuzzy' END AS match_type, round(CAST(c.score AS DOUBLE), 6) AS score
FROM walk k JOIN hop h ON h.query_id = k.query_id AND h.media_id = k.media_id AND h.anchor = k.anchor""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All occurrences of the shortened names in all brands."""
    found = occurrences.occurrences(brand_words(spark, sf_dir), name_lines(spark, sf_dir))
    return found.select("query_id", "media_id", "occ_idx", "matched_text", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "match_type", F.round("score", 6).alias("score"))


@query(f"""
WITH RECURSIVE {SQL_WINDOWS.format('true')}, {SQL_LCS},
v AS (SELECT query_id, media_id, s, n, w, 200.0 * common / (length(a) + length(b)) AS score FROM lcs JOIN q ON q.q = a JOIN w ON w.w = b),
best AS (SELECT query_id, media_id, arg_max({{'s': s, 'n': n, 'w': w, 'score': score}}, (score, -abs(n - 2), -s, -n)) AS c FROM v GROUP BY query_id, media_id)
SELECT query_id, media_id, c.w AS matched_text, round(CAST(c.s * 0.4 AS DOUBLE), 3) AS start, round(CAST((c.s + c.n) * 0.4 AS DOUBLE), 3) AS "end", round(CAST(c.score AS DOUBLE), 6) AS score FROM best""")
def best_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each shortened name in each brand, whatever its score."""
    found = occurrences.best_of_all(brand_words(spark, sf_dir), name_lines(spark, sf_dir))
    return found.select("query_id", "media_id", "matched_text", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("score", 6).alias("score"))


@query(f"""
WITH RECURSIVE f AS (SELECT x.p_partkey AS media_id, x.p_name || ' ' || y.p_name AS seen, string_split(x.p_name || ' ' || y.p_name, ' ') AS t FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1),
q AS (SELECT min(p_partkey) AS query_id, CASE WHEN length(p_name) % 2 = 0 THEN substr(p_name, 1, 3) || ' ' || replace(substr(p_name, 4), ' ', '') ELSE substr(p_name, 1, length(p_name) - 1) END AS q FROM part GROUP BY 2),
d AS (SELECT DISTINCT seen, t FROM f),
w AS (SELECT seen, s, n, array_to_string(t[s + 1:s + n], ' ') AS w FROM (SELECT *, unnest(range(0, len(t))) AS s FROM d), (SELECT unnest([1, 2, 3]) AS n) WHERE s + n <= len(t)),
x AS (SELECT query_id, seen, arg_min(w, s) AS w FROM q JOIN w ON n = 2 AND (w.w = q.q OR replace(w.w, ' ', '') = replace(q.q, ' ', '')) GROUP BY query_id, seen),
u AS (SELECT DISTINCT w FROM w), z AS (SELECT DISTINCT q FROM q),
pairs AS (SELECT q AS a, w AS b FROM z, u WHERE 200.0 * least(length(q), length(w)) >= 85 * (length(q) + length(w)) UNION SELECT replace(q, ' ', ''), replace(w, ' ', '') FROM z, u WHERE 200.0 * least(length(replace(q, ' ', '')), length(replace(w, ' ', ''))) >= 85 * (length(replace(q, ' ', '')) + length(replace(w, ' ', '')))), {SQL_LCS},
g AS (SELECT a, b, 200.0 * common / (length(a) + length(b)) AS score FROM lcs WHERE 200.0 * common >= 85.0 * (length(a) + length(b))),
k AS (SELECT q, w, greatest(coalesce(s.score, 0), coalesce(c.score, 0)) AS score FROM z JOIN u ON true LEFT JOIN g s ON s.a = q AND s.b = w LEFT JOIN g c ON c.a = replace(q, ' ', '') AND c.b = replace(w, ' ', '') WHERE s.score IS NOT NULL OR c.score IS NOT NULL),
y AS (SELECT query_id, seen, arg_max({{'w': w.w, 'score': k.score}}, (k.score, -s, -n)) AS c FROM q JOIN k ON k.q = q.q JOIN w ON w.w = k.w GROUP BY query_id, seen),
b AS (SELECT query_id, seen, w AS matched_text, 'exact' AS match_type, CAST(100 AS DOUBLE) AS score FROM x UNION ALL SELECT query_id, seen, c.w, 'fuzzy', CAST(c.score AS DOUBLE) FROM y WHERE (query_id, seen) NOT IN (SELECT (query_id, seen) FROM x))
SELECT b.query_id, f.media_id, matched_text, match_type, round(CAST(score AS DOUBLE), 6) AS score FROM b JOIN f ON f.seen = b.seen""")
def visible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that show two part names each; names with blanks moved (exact) or a letter missing (fuzzy) are looked for."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    lines = parts.join(after, "p_partkey").select(F.col("p_partkey").alias("media_id"), F.lit(0).alias("decode_idx"), F.posexplode(F.array("p_name", F.lit("  "), "next")).alias("line_idx", "text"))
    line = F.when(F.length("p_name") % 2 == 0, F.concat(F.substring("p_name", 1, 3), F.lit(" "), F.expr("replace(substring(p_name, 4), ' ', '')"))).otherwise(F.expr("substring(p_name, 1, length(p_name) - 1)"))
    asked = parts.groupBy(line.alias("text")).agg(F.min("p_partkey").alias("query_id")).select("query_id", "text")
    shown = frames.visible_text(frames.frame_texts(lines), asked)
    return shown.select("query_id", "media_id", "matched_text", "match_type", F.round("score", 6).alias("score"))


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, word_idx, text, start, end): each turn's words spread evenly over its four seconds."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), "turn", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    rows = rows.select("media_id", "turn", F.size("w").alias("n"), F.posexplode("w").alias("k", "text"))
    return rows.select("media_id", (F.col("turn") * 10000 + F.col("k")).cast("int").alias("word_idx"), "text", (F.col("turn") * 4.0 + F.col("k") * 4.0 / F.col("n")).alias("start"), (F.col("turn") * 4.0 + (F.col("k") + 1) * 4.0 / F.col("n")).alias("end"))


SHORT_LINES = ["the", "of", "la", "die"]
SQL_TURN_WORDS = r"""
t AS (SELECT conv_id AS media_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
k AS (SELECT media_id, turn, len(w) AS n, unnest(range(0, len(w))) AS k, unnest(w) AS text FROM t),
words AS (SELECT media_id, turn * 10000 + k AS word_idx, text, CAST(turn * 4.0 AS DOUBLE) + CAST(k * 4.0 AS DOUBLE) / n AS start, CAST(turn * 4.0 AS DOUBLE) + CAST((k + 1) * 4.0 AS DOUBLE) / n AS "end", lower(text) AS low FROM k),
q AS (SELECT unnest([0, 1, 2, 3]) AS query_id, unnest(['the', 'of', 'la', 'die']) AS q)"""
SQL_HELD = r"list_contains(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+'), q)"


@query(f"""
WITH {SQL_TURN_WORDS}, h AS (SELECT query_id, media_id, word_idx, trim(text) AS matched_text, start, "end" FROM words, q WHERE {SQL_HELD.format('low')})
SELECT CAST(query_id AS BIGINT) AS query_id, media_id, CAST(row_number() OVER (PARTITION BY query_id, media_id ORDER BY word_idx) - 1 AS INTEGER) AS occ_idx, matched_text, round(start, 3) AS start, round("end", 3) AS "end" FROM h""")
def short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one short word are found word for word only, once in each spoken word."""
    lines = spark.createDataFrame(list(enumerate(SHORT_LINES)), "query_id long, text string")
    found = occurrences.occurrences(occurrences.transcripts(turn_words(spark, sf_dir)), lines)
    return found.select("query_id", "media_id", "occ_idx", "matched_text", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(f"""
WITH {SQL_TURN_WORDS},
m AS (SELECT conv_id AS media_id, max(turn) * 4.0 + 5.0 AS duration FROM conversations GROUP BY conv_id),
c AS (SELECT CAST(query_id AS BIGINT) AS query_id, q, media_id, CAST(turn + 1 AS INTEGER) AS rank, turn * 4.0 AS start, turn * 4.0 + 2.0 AS "end" FROM t, q WHERE turn % 2 = 1),
w AS (SELECT c.*, g AS margin, greatest(0, start - g) AS ws, least(duration, c."end" + g) AS we FROM c JOIN m USING (media_id), (SELECT unnest([0.5, 1.5]) AS g)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, media_id ORDER BY rank, margin) AS window_rank FROM w WHERE we > ws),
f AS (SELECT r.query_id, r.media_id, r.window_rank, any_value(r.rank) AS rank, any_value(r.we - r.ws) AS seconds, min(words.word_idx) FILTER ({SQL_HELD.format('words.low')}) AS hit FROM r LEFT JOIN words ON words.media_id = r.media_id AND words.start >= r.ws AND words."end" <= r.we GROUP BY r.query_id, r.media_id, r.window_rank),
v AS (SELECT query_id, media_id, min(window_rank) FILTER (hit IS NOT NULL) AS winner FROM f GROUP BY query_id, media_id),
s AS (SELECT f.query_id, f.media_id, sum(f.seconds) AS seconds, any_value(winner) AS winner FROM f JOIN v USING (query_id, media_id) WHERE winner IS NULL OR window_rank <= winner GROUP BY f.query_id, f.media_id)
SELECT s.query_id, s.media_id, winner IS NOT NULL AS verified, round(CAST(s.seconds AS DOUBLE), 3) AS audio_processed_seconds, 'turn ' || (f.rank - 1) AS caption_text, round(words.start, 3) AS start, trim(words.text) AS matched_text
FROM s LEFT JOIN f ON f.query_id = s.query_id AND f.media_id = s.media_id AND f.window_rank = s.winner LEFT JOIN words ON words.media_id = s.media_id AND words.word_idx = f.hit""")
def verified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in order, each with its margins in order: the first window in which the line is heard, and the seconds tried."""
    rows = table(spark, sf_dir, "conversations")
    lines = spark.createDataFrame(list(enumerate(SHORT_LINES)), "query_id long, text string")
    media = rows.groupBy(F.col("conv_id").alias("media_id")).agg((F.max("turn") * 4.0 + 5.0).alias("duration")).withColumn("audio_start_time", F.lit(0.0))
    begin = F.col("turn") * 4.0
    found = rows.where("turn % 2 = 1").select(F.col("conv_id").alias("media_id"), F.lit("manual").alias("source"), F.lit("en").alias("language"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("text"), begin.alias("start"), (begin + 2.0).alias("end"), F.lit("fuzzy").alias("match_type"), F.lit(90.0).alias("score"), (F.col("turn") + 1).cast("int").alias("rank"))
    found = found.join(F.broadcast(lines.select("query_id")), F.lit(True))
    out = verify.verify(found, media, turn_words(spark, sf_dir), lines, margins=(0.5, 1.5))
    return out.select("query_id", "media_id", "verified", F.round("audio_processed_seconds", 3).alias("audio_processed_seconds"), "caption_text", F.round("start", 3).alias("start"), "matched_text")


# --- connectors, memo tables and publishing, with connectors that answer by a rule


@query(r"""
WITH w AS (SELECT conv_id AS media_id, turn, string_split(text, ' ') AS w FROM conversations), k AS (SELECT media_id, turn, unnest(range(0, len(w))) AS k, unnest(w) AS text FROM w)
SELECT media_id, CAST(turn * 10000 + k AS INTEGER) AS word_idx, text, CAST(turn * 4.0 + k AS DOUBLE) AS start FROM k WHERE k % 5 <> 4""")
def transcribed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words from a registered recogniser; those without times can't be placed."""

    def factory():
        def hear(row: dict) -> list[dict]:
            return [{"media_id": row["media_id"], "model": "base.en", "word_idx": row["turn"] * 10000 + k, "text": w, "start": None if k % 5 == 4 else row["turn"] * 4.0 + k, "end": row["turn"] * 4.0 + k + 0.5, "probability": 0.9} for k, w in enumerate(row["text"].split(" "))]

        return hear

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), "turn", "text")
    return timed_words(Connectors().register("transcribe", factory).run("transcribe", turns)).select("media_id", "word_idx", "text", "start")


@query("SELECT p_partkey AS media_id, CAST(p_size AS INTEGER) AS decode_idx, p_name || ' ' || p_brand AS text FROM part")
def read_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text from a registered reader, blank ones dropped, put together by frame."""

    def factory():
        return lambda row: [{"media_id": row["media_id"], "decode_idx": row["decode_idx"], "line_idx": k, "text": t, "confidence": None} for k, t in ((2, row["p_brand"]), (0, f" {row['p_name']} "), (1, "  "))]

    shots = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("media_id"), F.col("p_size").alias("decode_idx"), "p_name", "p_brand")
    return frames.frame_texts(Connectors().register("read_text", factory).run("read_text", shots))


@query("""
SELECT page_id AS media_id, CASE WHEN page_id % 5 IN (0, 4) THEN '/m/' || page_id || '.mp4' END AS path,
       CASE page_id % 5 WHEN 1 THEN 'not a media file: text/html' WHEN 2 THEN 'the download is not complete' WHEN 3 THEN '404' END AS error FROM pages""")
def direct_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct downloads by a registered connector: pages, unfinished files and failures are faults."""
    kinds = ["video/mp4", "text/html", "audio/ogg", "", ""]

    def factory():
        def fetch(row: dict) -> list[dict]:
            k = row["media_id"] % 5
            return [{"media_id": row["media_id"], "path": f"/m/{row['media_id']}.mp4" + ".part" * (k == 2), "length": 5, "content_type": kinds[k], "error": "404" if k == 3 else None}]

        return fetch

    found = downloaded(Connectors().register("download", factory), table(spark, sf_dir, "pages").select(F.col("page_id").alias("media_id")))
    return found.select("media_id", "path", "error")


@query("""
SELECT page_id AS media_id, CASE page_id % 3 WHEN 0 THEN '/m/first' WHEN 1 THEN '/m/fresh' END AS path, CASE page_id % 3 WHEN 2 THEN '403 again' END AS error FROM pages""")
def refreshed_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads that fail are inspected anew, once, and tried again with the fresh URL."""

    def fetch():
        def one(row: dict) -> list[dict]:
            fresh, k = row["video_url"] == "fresh", row["media_id"] % 3
            path = "/m/first" if not k else "/m/fresh" if fresh and k == 1 else None
            return [{"media_id": row["media_id"], "path": path, "length": 5, "content_type": "", "error": None if path else "403 again" if fresh else "403"}]

        return one

    def inspect():
        return lambda row: [{"media_id": row["media_id"], "metadata": "{}", "video_url": "fresh", "video_headers": {}}]

    asked = table(spark, sf_dir, "pages").select(F.col("page_id").alias("media_id"), F.lit("old").alias("video_url"))
    return Connectors().register("download", fetch).register("inspect", inspect).run_refreshed("download", asked).select("media_id", "path", "error")


@query("""
WITH f AS (SELECT user_id AS media_id, min(event_id) AS frame_index, arg_min(value, event_id) AS seen FROM events GROUP BY user_id), m AS (SELECT DISTINCT user_id AS media_id FROM events)
SELECT media_id, CAST(frame_index AS BIGINT) AS frame_index, round(seen, 6) AS frame_timestamp, CASE WHEN media_id % 2 = 1 THEN 'Media does not contain a video stream.' WHEN media_id % 3 = 1 THEN 'Media does not contain an audio stream.' END AS error FROM m JOIN f USING (media_id)""")
def inspected_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspection: what a medium lacks, and its first decodable frame."""
    e = table(spark, sf_dir, "events")
    shots = e.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("decode_idx"), F.col("event_id").alias("pts"), F.lit("1/1000").alias("time_base"), F.col("value").alias("timestamp"))
    media = e.select(F.col("user_id").alias("media_id")).distinct().select("media_id", (F.col("media_id") % 2 != 1).alias("has_video"), (F.col("media_id") % 3 != 1).alias("has_audio"), F.lit(60.0).alias("duration"))
    return search.inspect(media, shots).select("media_id", "frame_index", F.round("frame_timestamp", 6).alias("frame_timestamp"), "error")


@query("SELECT p_partkey, 'value of ' || p_name AS value, p_partkey % 2 = 0 AS known FROM part")
def memoised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are computed once a key: those of a first pass are read from the memo table in a second one."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", cache.digest(F.col("p_partkey")).alias("key"))
    path = f"{shared_folder(spark)}/memo-{uuid.uuid4().hex}"
    cache.memoised(parts.where("p_partkey % 2 = 0"), "key", "names", path, lambda rows: rows.select("key", F.concat(F.lit("value of "), "p_name").alias("value")))
    fresh = lambda rows: rows.select("key", F.concat(F.lit("new value of "), "p_name").alias("value"))
    found = cache.memoised(parts, "key", "names", path, fresh)
    return found.select("p_partkey", F.regexp_replace("value", "^new ", "").alias("value"), (~F.col("value").startswith("new")).alias("known"))


@query("""
WITH c AS (SELECT conv_id AS media_id, CAST(turn + 1 AS INTEGER) AS rank, turn * 4.0 AS start FROM conversations),
     w AS (SELECT *, greatest(0, start - 1.0) AS ws, start + 3.0 AS we, row_number() OVER (PARTITION BY media_id ORDER BY rank) AS n FROM c),
     h AS (SELECT *, media_id % 3 = 0 AND ws >= 7 AS hit FROM w),
     v AS (SELECT media_id, min(n) FILTER (hit) AS winner FROM h GROUP BY media_id)
SELECT h.media_id, any_value(winner) IS NOT NULL AS verified, CAST(any_value(CASE WHEN n = winner THEN 'turn ' || (rank - 1) END) AS VARCHAR) AS caption_text, round(CAST(sum(2 * (we - ws)) AS DOUBLE), 3) AS audio_processed_seconds
FROM h JOIN v USING (media_id) WHERE winner IS NULL OR n <= winner GROUP BY h.media_id""")
def precise_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in which the base words hold nothing go to a precise recogniser of the windows themselves, in rounds."""

    def factory():
        def hear(row: dict) -> list[dict]:
            said = "yes" if row["media_id"] % 3 == 0 and row["window_start"] >= 7 else "no"
            return [{"media_id": row["media_id"], "window_start": row["window_start"], "window_end": row["window_end"], "word_idx": 0, "text": said, "start": row["window_start"] + 0.5, "end": row["window_start"] + 1.0}]

        return hear

    rows = table(spark, sf_dir, "conversations")
    begin = F.col("turn") * 4.0
    found = rows.select(F.lit(1).cast("long").alias("query_id"), F.col("conv_id").alias("media_id"), F.lit("manual").alias("source"), F.lit("en").alias("language"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("text"), begin.alias("start"), (begin + 2.0).alias("end"), F.lit("fuzzy").alias("match_type"), F.lit(90.0).alias("score"), (F.col("turn") + 1).cast("int").alias("rank"))
    media = rows.select(F.col("conv_id").alias("media_id")).distinct().select("media_id", F.lit(None).cast("double").alias("duration"), F.lit(0.0).alias("audio_start_time"))
    lines = spark.createDataFrame([(1, "yes")], "query_id long, text string")
    silence = turn_words(spark, sf_dir).where(F.lit(False))
    hear = verify.by_connector(Connectors().register("recognise_window", factory), memo=f"{shared_folder(spark)}/clips-{uuid.uuid4().hex}", identity="precise")
    out = verify.verify(found, media, silence, lines, margins=(1.0,), precision_words=hear)
    return out.select("media_id", "verified", "caption_text", F.round("audio_processed_seconds", 3).alias("audio_processed_seconds"))


@query(f"""
WITH e AS (SELECT *, {SQL_SECONDS} AS sec FROM events)
SELECT event_id AS query_id, user_id AS media_id, substr(sha256(event_id || '|' || user_id || '|' || event_id % 40), 1, 32) AS frame_id, event_type AS matched_text, round(sec, 3) AS start, CAST(event_id % 40 AS INTEGER) AS frame_index, event_id % 5 = 0 AS conflict, CAST(CASE WHEN event_id % 3 <> 0 THEN event_id % 3 END AS INTEGER) AS n FROM e""")
def service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as a service gives them: nested, the frame under an opaque id."""
    rows = event_results(spark, sf_dir).withColumn("frame_index", (F.col("query_id") % 40).cast("int")).withColumn("evidence_conflict", F.coalesce("evidence_conflict", F.lit(False)))
    out = search.response(rows)
    return out.select("query_id", "media_id", "frame_id", "match.matched_text", F.round("match.start", 3).alias("start"), "frame.frame_index", F.col("evidence.evidence_conflict").alias("conflict"), F.col("match.occurrence_count").alias("n"))


@query("SELECT event_id, user_id AS media_id, CASE WHEN user_id % 2 = 0 THEN 'second' ELSE 'first' END AS run FROM events WHERE user_id % 2 = 1 OR event_id % 3 = 0")
def published_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run replaces what it has anew and leaves the rest of an earlier one."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("media_id"))
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    sinks.write(rows.withColumn("run", F.lit("first")), path)
    # media that the second run has nothing of keep their rows, so those of even numbers without a third event would stay
    second = rows.where("media_id % 2 = 0 AND event_id % 3 = 0").withColumn("run", F.lit("second"))
    sinks.write(second, path)
    found = spark.read.parquet(path).select("event_id", F.col("media_id").cast("long").alias("media_id"), "run")
    empty = rows.where("media_id % 2 = 0").groupBy("media_id").agg(F.max((F.col("event_id") % 3 == 0).cast("int")).alias("any")).where("any = 0")
    return found.join(empty, "media_id", "left_anti")
