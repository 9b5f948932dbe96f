from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from echoline.sources import metadata, subtitles, urls
from echoline.sources.connectors import Connectors, aligned, downloaded, timed_words

SRT = "1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hello</i>\r\n  there\r\n\r\n2\n00:00:05,000 --> 00:00:04,000\nback in time\n\n3\n00:00:00,250 --> 00:00:00,900\nfirst &amp; best\n"
VTT = "﻿WEBVTT\n\nNOTE x\n\n00:01.000 --> 00:02.000 align:start\nOne <c.x>two</c>\n\ncue\n01:00:00.500 --> 01:00:01.000\nlate\n"
JSON3 = "﻿" + json.dumps({"events": [{"tStartMs": 1500, "dDurationMs": 500, "segs": [{"utf8": "my "}, {"utf8": "mind"}]}, {"tStartMs": "x", "dDurationMs": 1, "segs": [{"utf8": "no"}]}, {"tStartMs": 1, "dDurationMs": 0, "segs": [{"utf8": "no"}]}, {"dDurationMs": 1, "segs": [{"utf8": "no"}]}, {"tStartMs": 0, "dDurationMs": 100, "segs": [{"utf8": "\n"}]}, {"tStartMs": 5}]})
TTML = '<tt><body><div><p begin="00:00:01.000" end="00:00:02.000">a<br/>b</p><p begin="3s" dur="1.5s">c &lt; d</p></div></body></tt>'
ASS = "[Events]\nFormat: Layer, Start, End\nDialogue: 0,0:00:01.50,0:00:02.00,Default,,0,0,0,,{\\i1}Hi, you\\Nthere\n"


def parse(spark, extension, content):
    df = spark.createDataFrame([(1, "manual", "en", extension, content)], "media_id long, source string, language string, extension string, content string")
    return [(r["text"], r["start"], r["end"]) for r in subtitles.cues(df).orderBy("cue_idx").collect()]


def test_subtitle_formats(spark):
    assert parse(spark, "srt", SRT) == [("first & best", 0.25, 0.9), ("Hello there", 1.0, 2.5)]
    assert parse(spark, "vtt", VTT) == [("One two", 1.0, 2.0), ("late", 3600.5, 3601.0)]
    assert parse(spark, "JSON3", JSON3) == [("my mind", 1.5, 2.0)]
    assert parse(spark, "ttml", TTML) == [("a b", 1.0, 2.0), ("c < d", 3.0, 4.5)]
    assert parse(spark, "ass", ASS) == [("Hi, you there", 1.5, 2.0)]


def ttml(body, head=""):
    return f'<?xml version="1.0"?>\n<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttp="http://www.w3.org/ns/ttml#parameter" {head}>{body}</tt>'


@pytest.mark.parametrize(("content", "wanted"), [
    (ttml('<body><p begin="00:00:01:12" end="00:00:02:00">frames</p></body>', 'ttp:frameRate="25"'), [("frames", 1.48, 2.0)]),
    (ttml('<body><p begin="00:00:01:15" end="00:00:02:00">thirty</p></body>'), [("thirty", 1.5, 2.0)]),
    (ttml('<body><p begin="0f" end="30f">multiplied</p></body>', 'ttp:frameRate="30" ttp:frameRateMultiplier="1000 1001"'), [("multiplied", 0.0, 1.001)]),
    (ttml('<body><p begin="10000000t" end="25000000t">ticks</p></body>', 'ttp:tickRate="10000000"'), [("ticks", 1.0, 2.5)]),
    (ttml('<body><p begin="50t" dur="50t">ticks are frames</p></body>', 'ttp:frameRate="25" ttp:subFrameRate="2"'), [("ticks are frames", 1.0, 2.0)]),
    (ttml('<body><p begin="1500ms" end="2m">b</p><p begin="0.001h" dur="2.5s">c</p></body>'), [("b", 1.5, 120.0), ("c", 3.6, 6.1)]),
    (ttml('<body begin="10s"><div begin="00:01:00.000"><p begin="1s" end="2s">nested</p><p end="3s">from the begin</p></div></body>'), [("from the begin", 70.0, 73.0), ("nested", 71.0, 72.0)]),
    (ttml('<body><div begin="5s" end="8s"><p>as long as its div</p><p begin="1s" dur="60s">cut</p></div></body>'), [("as long as its div", 5.0, 8.0), ("cut", 6.0, 8.0)]),
    (ttml('<body><div begin="2s" timeContainer="seq"><p dur="1s">one</p><p begin="0.5s" dur="1s">two</p></div><p begin="1s" end="9s" dur="2s">both</p></body>'), [("both", 1.0, 3.0), ("one", 2.0, 3.0), ("two", 3.5, 4.5)]),
    (ttml('<head><styling><style xml:id="s"/></styling></head><body><p begin="1s" end="2s">a <span tts:color="red">b</span>&nbsp;&amp;<br/>c&#233;</p></body>'), [("a b & cé", 1.0, 2.0)]),
    ('<tt:tt><tt:body><tt:p begin="1s" end="2s">prefixed</tt:p><tt:p begin="1s" end="1s">none</tt:p><tt:p begin="4s">no end</tt:p></tt:body></tt:tt>', [("prefixed", 1.0, 2.0)]),
    ('<tt><body><p begin="00:01.500" end="00:02,25">short clock</p><p begin="3s" end="4s">not closed<p begin="5s" end="6s">broken off', [("short clock", 1.5, 2.25), ("not closed", 3.0, 4.0), ("broken off", 5.0, 6.0)]),
])
def test_times_of_ttml(spark, content, wanted):
    assert parse(spark, "ttml", content) == wanted


def test_fields_of_ass(spark):
    head = "[Script Info]\nTitle: Format: x, y\n\n[V4+ Styles]\nFormat: Name, Fontname\nStyle: Default,Arial\n\n[Events]\n"
    assert parse(spark, "ass", head + "Format: Start, End, Style, Text\nDialogue: 0:00:01.00,0:00:02.50,Default,Well, yes\\hno <i>\nComment: 0:00:03.00,0:00:04.00,Default,hidden\n") == [("Well, yes no <i>", 1.0, 2.5)]
    assert parse(spark, "ssa", head + "Format: Marked, Text, End, Start\nDialogue: Marked=0,early,0:00:02.00,0:00:01.00\n") == [("early", 1.0, 2.0)]
    assert parse(spark, "ass", "Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,no format, no section\n") == [("no format, no section", 1.0, 2.0)]
    assert parse(spark, "ass", head + "format: layer, start, end, text\r\ndialogue: 0,0:00:01.00,0:00:02.00,low\r\n") == [("low", 1.0, 2.0)]


def test_cues_without_blank_lines(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\none\n2\n00:00:03,000 --> 00:00:04,000\ntwo\n\n\nmore of two\n\n3\n00:00:05,000 --> 00:00:06,000\n1984\n"
    assert parse(spark, "srt", srt) == [("one", 1.0, 2.0), ("two more of two", 3.0, 4.0), ("1984", 5.0, 6.0)]
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\none\n\nNOTE between\n\nname\n00:03.000 --> 00:04.000 line:0\ntwo\n\n00:05.000 --> 00:06.000\n\nSTYLE\n"
    assert parse(spark, "vtt", vtt) == [("one", 1.0, 2.0), ("two", 3.0, 4.0)]


@pytest.mark.parametrize(("extension", "content"), [("srt", ""), ("srt", None), ("vtt", " <!DOCTYPE html><p>"), ("srt", '{"error": 1}'), ("json3", "not json"), ("json3", "{}"), ("xyz", SRT)])
def test_unusable_subtitles(spark, extension, content):
    assert parse(spark, extension, content) == []


def test_downloads_kept(spark):
    rows = [("srt", SRT, True), ("srt", "", False), ("srt", None, False), ("vtt", " <HTML>", False), ("srt", "{}", False), ("json3", "{}", True), ("ass", ASS, False)]
    df = spark.createDataFrame(rows, "e string, c string, wanted boolean")
    assert all(r["got"] == r["wanted"] for r in df.withColumn("got", subtitles.is_usable(F.col("c"), F.col("e"))).collect())


def test_rationals(spark):
    df = spark.createDataFrame([("30000/1001", 30000 / 1001), ("25/1", 25.0), ("25", 25.0), ("0/0", None), (None, None), ("not-a-rate", None), ("1/2/3", None)], "r string, wanted double")
    assert all(x["got"] == x["wanted"] for x in df.withColumn("got", metadata.rational(F.col("r"))).collect())


def test_probe(spark):
    probe = {"format": {"duration": "12.5"}, "streams": [{"index": 0, "codec_type": "subtitle", "codec_name": "ass", "tags": {"language": "de", "title": "x"}}, {"index": 1, "codec_type": "video", "codec_name": "h264", "width": 640, "height": 360, "avg_frame_rate": "25/1", "time_base": "1/90000", "start_time": "N/A"}, {"index": 2, "codec_type": "audio", "codec_name": "aac", "start_time": "0.021"}, {"index": 3, "codec_type": "video", "codec_name": "png"}]}
    rows = spark.createDataFrame([(1, json.dumps(probe)), (2, "{}"), (3, None)], "media_id long, probe string")
    got = {r["media_id"]: r for r in metadata.media_info(rows, "probe").collect()}
    assert (got[1]["duration"], got[1]["video_codec"], got[1]["width"], got[1]["video_start_time"], got[1]["audio_start_time"]) == (12.5, "h264", 640, None, 0.021)
    assert got[1]["embedded_subtitles"][0].asDict() == {"index": 0, "codec": "ass", "language": "de", "title": "x"}
    assert (got[2]["has_video"], got[2]["has_audio"], got[3]["has_audio"], got[3]["embedded_subtitles"]) == (False, False, False, [])


def choose(spark, meta):
    df = metadata.parsed(spark.createDataFrame([(1, json.dumps(meta))], "media_id long, json string"), "json")
    row = df.select(metadata.video_source(F.col("meta")).alias("v"), metadata.audio_source(F.col("meta")).alias("a")).first()
    return row["v"] and row["v"]["url"], row["a"] and row["a"]["url"]


def test_stream_choice(spark):
    formats = [{"url": "tall", "vcodec": "h", "height": 1080}, {"url": "small", "vcodec": "h", "height": 360, "tbr": 9}, {"url": "fit", "vcodec": "h", "height": 720, "tbr": 1}, {"url": "fit2", "vcodec": "h", "height": 720, "tbr": 5}, {"url": "a1", "vcodec": "none", "acodec": "aac", "abr": 64}, {"url": "a2", "vcodec": "none", "acodec": "aac", "tbr": 128}, {"url": "av", "vcodec": "h", "acodec": "aac", "abr": 999, "height": 2000}]
    assert choose(spark, {"vcodec": "none", "formats": formats}) == ("fit2", "a2")
    assert choose(spark, {"requested_formats": [{"url": "r", "vcodec": "h"}, {"url": "ra", "vcodec": "none", "acodec": "x"}], "formats": formats})[0] == "r"
    assert choose(spark, {"url": "self", "acodec": "aac", "formats": formats})[0] == "self"
    assert choose(spark, {"formats": "oops"}) == (None, None)


def test_caption_inventory(spark):
    meta = {"subtitles": {"en": [{"ext": "vtt", "url": "u", "http_headers": {"a": "b"}}, None], "fr": "oops"}, "automatic_captions": {"de": [{"ext": "srt", "url": "x", "name": "German"}]}}
    df = metadata.parsed(spark.createDataFrame([(1, json.dumps(meta)), (2, "{}"), (3, "[]")], "media_id long, json string"), "json")
    got = [(r["source"], r["language"], r["extension"], r["name"], r["http_headers"]) for r in metadata.caption_tracks(df).collect()]
    assert sorted(got, key=str) == [("automatic", "de", "srt", "German", None), ("manual", "en", "vtt", None, {"a": "b"})]


def test_urls(spark):
    rows = [("", "", False), ("not a url", "not a url", False), ("file:///tmp/video.mp4", "file:///tmp/video.mp4", False), ("ftp://example.test/a", "ftp://example.test/a", False), ("[https://example.test/a\\_b](https://example.test/a\\_b?x=1\\&y=2)", "https://example.test/a_b?x=1&y=2", True), (" <https://example.test/x> ", "https://example.test/x", True), ("http://", "http://", False)]
    df = spark.createDataFrame(rows, "u string, clean string, ok boolean").withColumn("c", urls.clean(F.col("u")))
    assert all(r["c"] == r["clean"] and r["ok"] == r["got"] for r in df.withColumn("got", urls.is_public(F.col("c"))).collect())
    names = spark.createDataFrame([("https://e.test/a/b.MP4?x=.y",), ("https://e.test/",), ("https://e.test/a.verylongextension",), ("https://e.test/a.part",)], "u string").select(urls.file_name(F.col("u")).alias("n")).collect()
    assert [n["n"][:7] + n["n"][23:] for n in names] == ["direct-.mp4", "direct-.media", "direct-.media", "direct-.media"]


def test_stored_media(spark):
    files = spark.createDataFrame([("/c/tube-ab-c.mp4", 10, 1), ("/c/tube-ab-c.webm", 10, 2), ("/c/other-ab-c.mkv", 10, 9), ("/c/idx.mp4", 5, 1), ("/c/half-zzz.mp4.part", 5, 9), ("/c/empty-zzz.mp4", 0, 9), ("/c/else-only.mp4", 1, 1), ("/c/x-two.mp4", 1, 1), ("/c/y-two.mp4", 1, 1)], "path string, length long, modified long")
    requests = spark.createDataFrame([(1, "https://www.tube.test/watch?v=idx1"), (2, "https://www.tube.test/watch?v=ab-c"), (3, "https://tube.test/zzz"), (4, "https://tube.test/a/ab-c?id=none1"), (5, "https://tube.test/only"), (6, "https://tube.test/two")], "media_id long, url string")
    index = requests.where("media_id IN (1, 4)").select(urls.cache_key(F.col("url")).alias("key"), F.when(F.col("media_id") == 1, "/c/idx.mp4").otherwise("/c/../etc/x").alias("path"))
    got = {r["media_id"]: (r["path"], r["origin"]) for r in urls.stored_media(requests, index, files, "/c").collect()}
    assert got == {1: ("/c/idx.mp4", "index"), 2: ("/c/tube-ab-c.webm", "provider"), 3: (None, None), 4: ("/c/tube-ab-c.webm", "provider"), 5: ("/c/else-only.mp4", "provider"), 6: (None, None)}
    kinds = spark.createDataFrame([("video/mp4", True), ("", True), (None, True), ("Audio/x; a=b", True), ("text/html", False), ("application/octet-stream", True)], "t string, ok boolean")
    assert all(r["ok"] == r["got"] for r in kinds.withColumn("got", urls.is_media_type(F.col("t"))).collect())


def test_connectors(spark):
    class Fake:
        def __call__(self, row):
            return [{"media_id": row["media_id"], "model": "m", "word_idx": 0, "text": "hi", "start": 0.0, "end": None, "probability": None}]

    words = Connectors().register("transcribe", Fake).run("transcribe", spark.range(2).withColumnRenamed("id", "media_id"))
    assert words.count() == 2
    assert timed_words(words).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        Connectors().register("x", Fake)
    again = words.withColumn("start", F.lit(1.0)).withColumn("end", F.when(F.col("media_id") == 0, 2.0))
    assert {r["alignment_source"] for r in aligned(words, again).collect()} == {"whisperx", "faster-whisper"}


def test_refresh_once(spark):
    """A download that fails is inspected anew and tried once more, with the fresh URL."""

    def fetch():
        def one(row):
            good = row["video_url"] == "fresh" and row["media_id"] != 3 or row["media_id"] == 1
            return [{"media_id": row["media_id"], "path": f"/m/{row['media_id']}.mp4" if good else None, "length": 5, "content_type": "video/mp4", "error": None if good else f"403 for {row['video_url']}"}]

        return one

    inspect = lambda: lambda row: [{"media_id": row["media_id"], "metadata": "{}", "video_url": "fresh", "video_headers": {}}]
    c = Connectors().register("download", fetch).register("inspect", inspect)
    rows = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "media_id long, video_url string")
    got = {r["media_id"]: (r["path"], r["error"]) for r in c.run_refreshed("download", rows).collect()}
    assert got == {1: ("/m/1.mp4", None), 2: ("/m/2.mp4", None), 3: (None, "403 for fresh")}


def test_direct_downloads_are_checked(spark):
    answers = {1: ("/m/1.mp4", 9, "video/mp4"), 2: ("/m/2.mp4.part", 9, ""), 3: ("/m/3.mp4", 0, "audio/ogg"), 4: ("/m/4.html", 9, "text/html"), 5: ("/m/5.bin", 9, "application/octet-stream")}
    fetch = lambda: lambda row: [dict(zip(("path", "length", "content_type"), answers[row["media_id"]], strict=True), media_id=row["media_id"], error=None)]
    got = {r["media_id"]: r for r in downloaded(Connectors().register("download", fetch), spark.range(1, 6).withColumnRenamed("id", "media_id")).collect()}
    assert {k: r["path"] for k, r in got.items()} == {1: "/m/1.mp4", 2: None, 3: None, 4: None, 5: "/m/5.bin"}
    assert got[4]["error"] == "not a media file: text/html"


def test_stored_subtitles(spark):
    """The file of the name, else the largest finished one of its language; unfinished and empty ones never."""
    files = [("/c/1/manual.en.vtt", 5), ("/c/1/manual.en.7.vtt", 50), ("/c/2/manual.en.1.vtt", 5), ("/c/2/manual.en.2.vtt", 9), ("/c/2/manual.en.3.vtt.part", 99), ("/c/3/manual.en.vtt", 0), ("/c/3/manual.de.vtt", 5), ("/c/4/manual.pt_BR.vtt", 5)]
    tracks = spark.createDataFrame([(1, "manual", "en", "vtt"), (2, "manual", "en", "VTT"), (3, "manual", "en", "vtt"), (4, "manual", "pt_BR", "vtt"), (4, "manual", "pt_BR", "srt")], "media_id long, source string, language string, extension string")
    got = {(r["media_id"], r["extension"]): r["path"] for r in subtitles.stored(tracks, spark.createDataFrame(files, "path string, length long")).collect()}
    assert got == {(1, "vtt"): "/c/1/manual.en.vtt", (2, "VTT"): "/c/2/manual.en.2.vtt", (3, "vtt"): None, (4, "vtt"): "/c/4/manual.pt_BR.vtt", (4, "srt"): None}
