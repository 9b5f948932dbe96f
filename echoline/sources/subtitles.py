"""Subtitle files as cue tables: json3, vtt, srt, ttml, ass and ssa, by built-in functions.

Input rows: (media_id, source, language, extension, content). Cues without text or of no length are left out; the rest
is numbered by time. A file that yields no cue is in `unusable` with its message, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.functions.text import collapse, safe_name
from echoline.sources import timed_text
from echoline.sources.urls import is_complete

MOST_BYTES = 10 << 20
JSON3 = "struct<events:array<string>>"
EVENT = "struct<tStartMs:string,dDurationMs:string,segs:array<struct<utf8:string>>>"
#: The fields of an event where no Format line names them.
ASS_FIELDS = ["layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text"]
CLOCK = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,:](\d{1,3})"


def clock_seconds(text: Column) -> Column:
    """Seconds of [HH:]MM:SS.fff; the fraction may have one to three digits."""
    part = lambda k: F.coalesce(F.regexp_extract(text, CLOCK, k).try_cast("double"), F.lit(0.0))
    fraction = F.rpad(F.regexp_extract(text, CLOCK, 4), 3, "0").try_cast("double") / 1000
    return F.when(text.rlike(CLOCK), F.round(part(1) * 3600 + part(2) * 60 + part(3) + fraction, 3))


def _lines(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, "^﻿", ""), "\r\n?", "\n")


def _plain(text: Column, markup: bool = True) -> Column:
    """Text without override codes; with markup also without tags, entities resolved."""
    text = F.regexp_replace(text, r"\{\\[^}]*\}", "")
    if markup:
        text = F.regexp_replace(text, r"<[^>]*>", "")
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            text = F.replace(text, F.lit(entity), F.lit(sign))
    return collapse(F.regexp_replace(text, r"\\[Nnh]", " "))


def json3_cues(files: DataFrame) -> DataFrame:
    event = F.from_json("event", EVENT)
    rows = files.select("*", F.explode(F.from_json(_lines(F.col("content")), JSON3)["events"]).alias("event")).withColumn("e", event)
    begin, length = F.col("e.tStartMs").try_cast("double"), F.col("e.dDurationMs").try_cast("double")
    text = collapse(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    return rows.where(F.col("e.segs").isNotNull() & begin.isNotNull() & (length > 0)).select("media_id", "source", "language", text.alias("text"), (begin / 1000).alias("start"), ((begin + length) / 1000).alias("end"))


def block_cues(files: DataFrame) -> DataFrame:
    """srt and vtt: the lines below each arrow line, up to the next one; the line right before that may be its number or name.
    A cue of vtt ends with the first blank line, one of srt may hold blank lines."""
    lines = F.concat(F.lit("\n"), _lines(F.col("content")))
    parts = F.split(lines, r"\n(?=[^\n]*-->)")
    rows = files.select("media_id", "source", "language", (F.lower("extension") == "vtt").alias("vtt"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("parts"))
    rows = rows.select("media_id", "source", "language", "vtt", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
    arrow, below = F.regexp_extract("part", r"^([^\n]*)", 1), F.regexp_extract("part", r"(?s)^[^\n]*\n?(.*)$", 1)
    own = F.when(F.col("k") < F.col("n") - 1, F.regexp_replace(below, r"(?:^|\n)[ \t]*\d+[ \t]*$", "")).otherwise(below)
    text = _plain(F.when(F.col("vtt"), F.regexp_replace(own, r"(?s)(^|\n)[ \t]*\n.*$", "")).otherwise(own))
    return rows.select("media_id", "source", "language", text.alias("text"), clock_seconds(F.split(arrow, "-->")[0]).alias("start"), clock_seconds(F.split(arrow, "-->")[1]).alias("end"))


def ass_cues(files: DataFrame) -> DataFrame:
    """Fields are where the Format line of the events says; the text is the last one and may hold commas."""
    content = _lines(F.col("content"))
    events = F.coalesce(F.nullif(F.regexp_extract(content, r"(?is)(?:^|\n)\s*\[events\][^\n]*\n(.*)$", 1), F.lit("")), content)
    form = F.regexp_extract(events, r"(?i)(?:^|\n)[ \t]*Format[ \t]*:([^\n]*)", 1)
    named = F.transform(F.split(F.lower(form), ","), lambda f: F.trim(f))
    fields = F.when(F.size(F.array_intersect(named, F.array(*map(F.lit, ("start", "end", "text"))))) == 3, named).otherwise(F.array(*map(F.lit, ASS_FIELDS)))
    rows = files.select("media_id", "source", "language", fields.alias("fields"), F.explode(F.split(events, "\n")).alias("line")).where(F.col("line").rlike(r"(?i)^\s*Dialogue\s*:"))
    rows = rows.withColumn("part", F.split(F.regexp_replace("line", r"(?i)^\s*Dialogue\s*:\s*", ""), ",", F.size("fields")))
    value = lambda name: F.get("part", F.array_position("fields", F.lit(name)).cast("int") - 1)
    return rows.select("media_id", "source", "language", _plain(value("text"), markup=False).alias("text"), clock_seconds(value("start")).alias("start"), clock_seconds(value("end")).alias("end"))


def stored(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """tracks (media_id, source, language, extension) with `path` of a finished download: the file
    `<media_id>/<source>.<language>.<extension>`, else the largest other one of the language whose name goes on, e.g. by
    a number that the downloader put in (null: none). files: (path, length)."""
    name = F.concat_ws(".", "source", safe_name(F.col("language")))
    asked = tracks.select("*", F.concat(F.col("media_id").cast("string"), F.lit("/"), name).alias("stem"))
    part = F.split("path", "/")
    done = files.where(is_complete(F.col("path"), F.col("length"))).select("path", "length", F.element_at(part, -2).alias("folder"), F.element_at(part, -1).alias("name"))
    piece = F.split("name", r"\.")
    done = done.where(F.size(piece) > 2).select("path", "length", F.concat("folder", F.lit("/"), piece[0], F.lit("."), piece[1]).alias("stem"), F.substring_index("name", ".", -1).alias("ending"), (F.size(piece) == 3).alias("plain"))
    order = F.struct("plain", "length", "path")
    found = asked.join(done, (asked["stem"] == done["stem"]) & (F.lower(asked["extension"]) == F.lower(done["ending"])), "left")
    return found.groupBy(*tracks.columns).agg(F.max_by("path", order).alias("path"))


READERS = {("json3",): json3_cues, ("vtt", "srt"): block_cues, ("ttml",): timed_text.cues, ("ass", "ssa"): ass_cues}


def is_usable(content: Column, extension: Column) -> Column:
    """Whether a download is kept: not empty, not too large, and neither a web page nor (but for json3) anything that
    begins like JSON. That turns away files that open with a section in brackets too; parsing itself takes them."""
    head = F.lower(F.ltrim(F.substring(content, 1, 512)))
    page = head.startswith("<!doctype html") | head.startswith("<html")
    error = (head.startswith("{") | head.startswith("[")) & (F.lower(extension) != "json3")
    return F.coalesce((F.octet_length(content) > 0) & (F.octet_length(content) <= MOST_BYTES) & ~page & ~error, F.lit(False))


def cues(files: DataFrame) -> DataFrame:
    """(media_id, source, language, cue_idx, text, start, end) of all files."""
    out = None
    for extensions, reader in READERS.items():
        found = reader(files.where(F.lower("extension").isin(*extensions)))
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("media_id", "source", "language").orderBy("start", "end", "text")
    return out.where((F.col("text") != "") & (F.col("end") > F.col("start"))).withColumn("cue_idx", F.row_number().over(order) - 1).select("media_id", "source", "language", "cue_idx", "text", "start", "end")


def unusable(files: DataFrame, found: DataFrame) -> DataFrame:
    keys = ["media_id", "source", "language"]
    return files.join(found.select(*keys).distinct(), keys, "left_anti").select(*keys, F.concat(F.lit("Subtitle track contains no usable entries: "), F.col("language")).alias("message"))
