from __future__ import annotations

import io
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from echoline.operators import intervals, lazily, verify
from echoline.sources import ranges, stored
from echoline.sources.connectors import Connectors
from echoline.sources.stored import Files, Shards

VTT = "WEBVTT\n\n00:01.000 --> 00:02.000\nhello"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored"))
    files = [(m, f"{s}.{lang}.vtt", VTT) for m in range(-3, 40) for s in ("manual", "automatic") for lang in ("en", "de")]
    files += [(1, "manual.fr.vtt", " <!DOCTYPE html><html>"), (1, "manual.it.vtt", '{"error": 1}'), (1, "manual.es.json3", '{"events": []}'), (1, "manual.nl.srt", ""), (2, "manual.fr.vtt", "﻿WEBVTT")]
    files += [(5, "inspect.json", '{"title": "x"}'), (6, "inspect.json", "[1]"), (7, "inspect.json", "{")]
    files += [(5, "words.base.en.json", json.dumps({"words": [{"text": "a", "start": 0, "end": 1.5, "probability": 0.5}, {"text": "b", "start": None, "end": 2}, 7, {"text": None, "start": 3.0, "end": 4}]})), (6, "words.tiny.json", "[]"), (7, "words.tiny.json", "no")]
    files += [(5, "a.wav", "RIFFxxxx"), (5, "b.mp4", "<html>"), (5, "c.mp4.part", "x"), (5, "d.mkv", "")]
    rows = spark.createDataFrame([(m, n, bytearray(c.encode())) for m, n, c in files], "media_id long, name string, content binary")
    told = stored.store(rows, path).collect()
    assert len(told) == len(files) and all(r["error"] is None and os.path.getsize(r["path"]) == r["length"] for r in told)
    return path


def test_names_that_cannot_be_stored(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a.vtt", b""), (1, "../a", b""), (1, None, b""), (1, "ok.vtt", None)], "media_id long, name string, content binary")
    got = {(r["media_id"], r["name"]): r["error"] for r in stored.store(rows, str(tmp_path)).collect()}
    assert got.pop((1, "ok.vtt")) is None
    assert set(got.values()) == {"no name that can be stored"}


def test_filters_are_pushed_and_right(spark, root):
    every = stored.read(spark, root, "subtitles", 3).collect()
    assert len(every) == 43 * 4 + 5
    conditions = [
        ("media_id = 7", lambda r: r["media_id"] == 7), ("media_id IN (3, 5, -3) AND language = 'de'", lambda r: r["media_id"] in (3, 5, -3) and r["language"] == "de"),
        ("media_id > 30 AND source = 'manual'", lambda r: r["media_id"] > 30 and r["source"] == "manual"), ("language LIKE 'd%'", lambda r: r["language"].startswith("d")),
        ("media_id <> 4 AND extension IN ('srt', 'json3')", lambda r: r["media_id"] != 4 and r["extension"] in ("srt", "json3")), ("media_id = 1 OR language = 'fr'", lambda r: r["media_id"] == 1 or r["language"] == "fr"),
        ("content LIKE '%hello%' AND media_id < 2", lambda r: r["content"] is not None and "hello" in r["content"] and r["media_id"] < 2), ("media_id = 3 AND media_id = 4", lambda r: False), ("media_id IS NULL", lambda r: False),
    ]
    plain, base = stored.read(spark, root, "subtitles", 3), stored.where(spark, root, "subtitles", "length >= 0 OR length IS NULL", 3)
    for condition, keep in conditions:  # a table of its own, one that was asked before with other filters, and one without pushing
        for df in (stored.where(spark, root, "subtitles", condition, 3), base.where(condition), plain.where(condition)):
            got = sorted(map(tuple, df.collect()), key=repr)
            assert got == sorted((tuple(r) for r in every if keep(r)), key=repr), condition
    assert base.count() == plain.count() == len(every)
    one, other = base.where("media_id = 7"), base.where("media_id = 8")
    both = one.alias("a").join(other.alias("b"), F.col("a.language") == F.col("b.language")).select("a.media_id", F.col("b.media_id").alias("m")).distinct().collect()
    assert [tuple(r) for r in both] == [(7, 8)]
    assert sorted(r["media_id"] for r in one.unionByName(other).select("media_id").distinct().collect()) == [7, 8]
    plan = stored.where(spark, root, "subtitles", "media_id = 7 AND language = 'en' AND length(content) > 3")._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line]
    assert len(filters) == 1 and "length(content" in filters[0] and "media_id" not in filters[0] and "language" not in filters[0]  # the rest is pushed


def test_pushed_filters_prune_shards_and_files(root):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    files = Files(root, "subtitles")
    left = list(files.take([EqualTo(("media_id",), 7), In(("language",), ("en", None)), StringContains(("content",), "x"), EqualTo(("length",), 3)]))
    assert [type(f) for f in left] == [StringContains, EqualTo]
    assert [p.names for p in files.planned()] == [[stored.shard_of(7)]]
    assert [row["media_id"] for *_, row, _ in files.listed(files.planned()[0])] == [7, 7]
    other = Files(root, "subtitles")
    assert not list(other.take([GreaterThan(("media_id",), 100)]))
    assert len(other.planned()) == stored.PARTITIONS and not [r for p in other.planned() for r in other.rows(p)]
    assert not list(Files(root, "subtitles").rows(Shards(["not there"])))


def test_faults_are_rows(spark, root):
    subtitles = {(r["media_id"], r["language"]): (r["content"], r["error"]) for r in stored.read(spark, root, "subtitles", 3).where("source = 'manual' AND media_id IN (1, 2)").collect()}
    assert subtitles[1, "fr"] == (None, "the subtitle is a web page")
    assert subtitles[1, "it"] == (None, "the subtitle is an error message")
    assert subtitles[1, "es"] == ('{"events": []}', None)
    assert subtitles[1, "nl"] == (None, "the file is empty")
    assert subtitles[2, "fr"] == ("WEBVTT", None)
    inspected = {r["media_id"]: (r["metadata"], r["error"]) for r in stored.read(spark, root, "inspect", 3).collect()}
    assert inspected == {5: ('{"title": "x"}', None), 6: (None, "the metadata is no object"), 7: (None, "the metadata is no JSON")}
    words = {(r["media_id"], r["word_idx"]): (r["model"], r["text"], r["start"], r["end"], r["probability"], r["error"]) for r in stored.read(spark, root, "words", 3).collect()}
    assert words == {(5, 0): ("base.en", "a", 0.0, 1.5, 0.5, None), (5, 2): ("base.en", "", 3.0, 4.0, None, None), (6, None): ("tiny", None, None, None, None, "the transcription holds no timed words"), (7, None): ("tiny", None, None, None, None, "the transcription is no JSON")}
    media = {os.path.basename(r["path"]): (r["content_type"], r["error"]) for r in stored.read(spark, root, "media", 3).collect()}
    assert media == {"a.wav": ("audio/wav", None), "b.mp4": ("text/html", "not a media file: text/html"), "c.mp4.part": (None, "the download is not complete"), "d.mkv": (None, "the download is not complete")}


def test_large_files_are_not_opened(root, monkeypatch):
    monkeypatch.setattr(stored, "content", lambda system, info, most=3: (None, "the file is too large") if info.size > most else (None, None))
    files = Files(root, "subtitles")
    assert {r[-1] for p in files.planned() for r in files.rows(p)} == {"the file is too large", None}


def test_unknown_kind(spark, root):
    with pytest.raises(Exception, match="kind must be one of"):
        stored.read(spark, root, "pictures", 3).collect()


def test_stream_gives_each_file_once(spark, tmp_path):
    root, out = str(tmp_path / "files"), str(tmp_path / "out")
    put = lambda ids: stored.store(spark.createDataFrame([(i, "manual.en.vtt", bytearray(VTT.encode())) for i in ids], "media_id long, name string, content binary"), root).collect()
    stored.register(spark)

    def pass_over():
        stream = spark.readStream.format("stored").option("kind", "subtitles").option("settle", "0").option("partitions", 3).load(root)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["media_id"] for r in spark.read.parquet(out).collect())

    put(range(5))
    assert pass_over() == [0, 1, 2, 3, 4]
    put([9, 300])
    assert pass_over() == [0, 1, 2, 3, 4, 9, 300]


# --- recordings


def wav(samples, rate=10, width=1, junk=b""):
    data = bytes(samples)
    extra = (b"LIST" + struct.pack("<I", len(junk)) + junk + b"\0" * (len(junk) & 1)) if junk else b""
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * width, width, 8 * width) + extra + b"data" + struct.pack("<I", len(data)) + data


def test_waves():
    wave = ranges.Wave(io.BytesIO(wav(range(100), junk=b"abc")))
    assert wave.part(1.0, 2.0) == (10, bytes(range(10, 20)))
    assert wave.part(0.05, 0.11) == (0, bytes([0, 1]))
    assert wave.part(9.5, 99.0) == (95, bytes(range(95, 100)))
    assert wave.part(50.0, 60.0) == (100, b"")
    assert wave.part(-1.0, 0.1) == (0, b"\0")
    two = ranges.Wave(io.BytesIO(wav(range(100), width=2)))
    assert (two.samples, two.part(1.0, 1.1)) == (50, (10, bytes([20, 21])))
    for bad in (b"", b"RIFF0000WAVE", wav(range(9))[:40], b"ID3" + b"x" * 60, wav(range(100))[:60]):
        with pytest.raises((ValueError, struct.error)):
            ranges.Wave(io.BytesIO(bad)).part(0.0, 9.0)


def test_remote_then_local(spark, tmp_path):
    """Bytes read fall with the windows; only failed windows reach the local reader; the result is that of a full reading."""
    sound = bytes(random.Random(1).randrange(256) for _ in range(5000))
    for name, data in (("good", wav(sound)), ("short", wav(sound)[:2000]), ("text", b"<html>")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "local").write_bytes(wav(sound))
    local = str(tmp_path / "local")
    rows = [(1, 10.0, 12.0, str(tmp_path / "good"), None), (1, 10.0, 12.0, str(tmp_path / "good"), None), (2, 300.0, 301.5, str(tmp_path / "short"), local), (2, 3.0, 4.0, str(tmp_path / "short"), local), (3, 0.0, 1.0, str(tmp_path / "text"), local), (4, 0.0, 1.0, None, local), (5, 0.0, 1.0, str(tmp_path / "gone"), None)]
    df = spark.createDataFrame(rows, "media_id long, window_start double, window_end double, remote string, local string")
    got = {(r["media_id"], r["window_start"]): r for r in ranges.seek(df, "remote", "local").collect()}
    assert len(got) == 6
    assert {k: r["origin"] for k, r in got.items()} == {(1, 10.0): "remote", (2, 300.0): "local", (2, 3.0): "remote", (3, 0.0): "local", (4, 0.0): "local", (5, 0.0): "local"}
    for (_, start), r in got.items():
        if r["error"] is None:
            assert bytes(r["audio"]) == sound[int(start * 10) : int(r["window_end"] * 10)]
            assert r["bytes_read"] == 44 + len(r["audio"])
    assert got[5, 0.0]["error"] and got[5, 0.0]["remote_error"].startswith("FileNotFoundError")
    assert got[3, 0.0]["remote_error"] == "ValueError: not a WAV file"


def test_windows_are_heard_from_their_own_samples(spark, tmp_path):
    text = b"....yes...............no......"
    (tmp_path / "a").write_bytes(wav(text, rate=1))
    media = spark.createDataFrame([(1, "/nowhere", str(tmp_path / "a"), 30.0, 2.0)], "media_id long, remote_path string, path string, duration double, audio_start_time double")

    def factory():
        def hear(row):
            at = bytes(row["audio"]).find(b"no")
            found = [{"word_idx": 0, "text": "no", "start": row["begins"] + at, "end": row["begins"] + at + 2}] if at >= 0 else []
            return [{**{k: row[k] for k in ranges.SPAN}, **w} for w in found]

        return hear

    hear = ranges.recogniser(media, Connectors().register("recognise_window", factory))
    lines = spark.createDataFrame([(1, "no")], "query_id long, text string")
    found = [(1, 1, "manual", "en", "yes", 4.0, 7.0, "fuzzy", 90.0, 1), (1, 1, "manual", "en", "no", 22.0, 24.0, "fuzzy", 90.0, 2)]
    candidates = spark.createDataFrame(found, "query_id long, media_id long, source string, language string, text string, start double, end double, match_type string, score double, rank int")
    r = verify.verify(candidates, media, hear, lines, margins=(1.0,)).first()
    assert (r["verified"], r["start"], r["end"], r["caption_text"]) == (True, 24.0, 26.0, "no")  # moved by the start of the audio


# --- evidence in rounds


@pytest.mark.parametrize("memo", [False, True])
def test_frames_are_read_in_rounds(spark, tmp_path, memo):
    """Against a walk in order: the same hits and counts; the reader sees no image twice and none behind the hit's round."""
    rng = random.Random(3)
    texts = ["", "wrong line", "the right line", "the rigt line", "another", "THE RIGHT LINE!"]
    offered = [(q, m, d, None if rng.random() < 0.1 else f"{rng.choice([1, 1, 1, 4, 0, 2, 3, 5])}") for q in range(4) for m in range(5) for d in rng.sample(range(100), rng.randint(1, 9))]
    wanted = {0: "the right line", 1: "wrong line", 2: "never shown anywhere", 3: "?!"}
    calls = tmp_path / "calls"
    calls.mkdir()

    def factory():
        def read(row):
            (calls / f"{row['image_digest']}-{row['media_id']}-{row['decode_idx']}-{random.SystemRandom().random()}").touch()
            text = texts[int(row["image_digest"])] if row["image_digest"] else "frame of its own"
            return [{"media_id": row["media_id"], "decode_idx": row["decode_idx"], "line_idx": 0, "text": text, "confidence": 1.0}]

        return read

    frames_ = spark.createDataFrame(offered, "query_id long, media_id long, decode_idx int, image_digest string")
    lines = spark.createDataFrame(list(wanted.items()), "query_id long, text string")
    connectors = Connectors().register("read_text", factory)
    folder = str(tmp_path / "memo") if memo else None
    got = {(r["query_id"], r["media_id"]): r for r in lazily.first_visible(frames_, lines, connectors, memo=folder, identity="x").collect()}
    expected_reads = set()
    for q in range(4):
        for m in range(5):
            mine = sorted((d, i) for a, b, d, i in offered if (a, b) == (q, m))
            hit = next((k for k, (_, i) in enumerate(mine, 1) if i and texts[int(i)] and ("right" in texts[int(i)].lower() or "rigt" in texts[int(i)]) and q == 0 or i == "1" and q == 1), None)
            processed = hit or len(mine)
            asked = min(len(mine), (1 << processed.bit_length()) - 1)
            if q == 3:
                processed = asked = 0
            r = got[q, m]
            assert (r["processed"], r["asked"], r["decode_idx"]) == (processed, asked, mine[hit - 1][0] if hit else None), (q, m)
            expected_reads |= {i or (m, d) for d, i in mine[:asked]}
    read = [p.name.rsplit("-", 1)[0].split("-") for p in calls.iterdir()]
    assert len(read) == len(expected_reads)
    assert {(int(m), int(d)) if i == "None" else i for i, m, d in read} == expected_reads
    if memo:
        again = {(r["query_id"], r["media_id"]): r["asked"] for r in lazily.first_visible(frames_, lines, connectors, memo=folder, identity="x").collect()}
        assert again == {k: r["asked"] for k, r in got.items()} and len(list(calls.iterdir())) == len(read)


def test_nothing_to_look_for(spark):
    lines = spark.createDataFrame([(1, "... !")], "query_id long, text string")
    offered = spark.createDataFrame([(1, 1, 5, "a")], "query_id long, media_id long, decode_idx int, image_digest string")
    r = lazily.first_visible(offered, lines, Connectors()).first()
    assert (r["processed"], r["asked"], r["decode_idx"]) == (0, 0, None)


def test_variants_are_fetched_one_after_another(spark, tmp_path):
    """Against a walk round by round in plain Python, with what was fetched."""
    rng = random.Random(5)
    calls = tmp_path / "calls"
    calls.mkdir()
    tracks = [(m, s, lang, e, k, rng.random() < 0.2, rng.choice(["good", "page", "empty", "none", "limit" if rng.random() < 0.4 else "page"])) for m in range(12) for s in ("manual", "automatic") for lang in ("en", "de") for k, e in enumerate(rng.sample(["vtt", "srt", "json3", "ttml"], rng.randint(0, 4)))]
    served = {"good": {"vtt": VTT, "srt": VTT, "ttml": '<p begin="00:00:01.000" end="00:00:02.000">hello</p>', "json3": '{"events":[{"tStartMs":1,"dDurationMs":5,"segs":[{"utf8":"hi"}]}]}'}}
    content = lambda kind, e: {"good": served["good"][e], "page": "<html>", "empty": ""}.get(kind)

    def factory():
        def fetch(row):
            (calls / f"{row['media_id']}-{row['source']}-{row['language']}-{row['track_rank']}").touch(exist_ok=False)
            if row["kind"] == "none":
                return []
            return [{**{k: row[k] for k in ("media_id", "source", "language", "extension")}, "content": content(row["kind"], row["extension"]), "rate_limited": row["kind"] == "limit"}]

        return fetch

    schema = "media_id long, source string, language string, extension string, track_rank int, cached boolean, kind string"
    df = spark.createDataFrame(tracks, schema)
    held = spark.createDataFrame([(m, s, lang, e, content(kind, e)) for m, s, lang, e, _, cached, kind in tracks if cached], "media_id long, source string, language string, extension string, content string")
    chosen, attempts = lazily.fetch_variants(df, Connectors().register("fetch_subtitle", factory), held)
    groups = {}
    for t in tracks:
        groups.setdefault(t[:3], []).append(t)
    tried, picked, limited = {}, {}, set()
    for k in range(4):
        now = [(g, sorted(ts, key=lambda t: (not t[5], t[4]))[k]) for g, ts in groups.items() if len(ts) > k and g not in picked and g[0] not in limited]
        for g, t in now:
            kind = t[6] if not t[5] or t[6] in ("good", "page", "empty") else "none"
            tried[g, t[4]] = {"good": "parsed", "page": "unusable", "empty": "unusable", "none": "missing", "limit": "rate_limited"}[kind]
            if kind == "good":
                picked[g] = t[4]
        limited |= {g[0] for g, t in now if tried[g, t[4]] == "rate_limited"}
    assert limited and len(limited) < 12
    got = {((r["media_id"], r["source"], r["language"]), r["track_rank"]): r["outcome"] for r in attempts.collect()}
    assert got == tried
    assert {(r["media_id"], r["source"], r["language"]): r["track_rank"] for r in chosen.collect()} == {g: k for g, k in picked.items() if g[0] not in limited}
    fetched = {tuple(p.name.split("-")) for p in calls.iterdir()}
    cached = {(t[:3], t[4]) for t in tracks if t[5]}
    assert fetched == {(str(g[0]), g[1], g[2], str(k)) for g, k in tried if (g, k) not in cached}


def test_no_tracks(spark):
    df = spark.createDataFrame([], "media_id long, source string, language string, extension string, track_rank int, cached boolean")
    chosen, attempts = lazily.fetch_variants(df, Connectors())
    assert chosen.collect() == [] and attempts.collect() == []
    assert chosen.columns[-1] == "content" and attempts.columns[-1] == "outcome"


# --- intervals


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_of_any_length(spark, seed):
    rng = random.Random(seed)
    span = lambda k: (k, k % 3, a := rng.choice([rng.uniform(-500, 500), float(rng.randrange(-480, 480, 60))]), a + rng.choice([0.0, 60.0, -1.0, rng.uniform(0, 10), 120.0, rng.uniform(0, 1e4), 6e7]))
    a, b = [span(k) for k in range(120)], [span(k) for k in range(130)]
    left = spark.createDataFrame(a, "a long, key long, low double, high double")
    right = spark.createDataFrame(b, "b long, key long, start double, end double")
    got = sorted((r["a"], r["b"]) for r in intervals.overlap_join(left, right, ["key"], "low", "high", "start", "end").collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    inside = sorted((r["a"], r["b"]) for r in intervals.interval_join(left, right, ["key"], "low", "high", "start", "end").collect())
    assert inside == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= x[3] and x[2] <= y[2] and y[3] <= x[3])
    copies = intervals.bucketed(left, "low", "high", 60.0).groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert copies <= 3


def test_an_image_is_compared_with_a_target_once_a_round(spark, monkeypatch):
    """However many media it stands in; hits are told for every frame that holds it."""
    compared, shown = [], lazily.shown
    monkeypatch.setattr(lazily, "shown", lambda pairs, threshold: compared.append(pairs.count()) or shown(pairs, threshold))
    offered = spark.createDataFrame([(1 + m % 2, m, 10 * k, "img:a line" if k == 1 + m % 3 else "img:else") for m in range(30) for k in range(5)], "query_id long, media_id long, decode_idx int, image_digest string")
    lines = spark.createDataFrame([(1, "a line"), (2, "A line!")], "query_id long, text string")
    connectors = Connectors().register("read_text", lambda: lambda row: [{"media_id": row["media_id"], "decode_idx": row["decode_idx"], "line_idx": 0, "text": row["image_digest"].removeprefix("img:"), "confidence": 0.9}])
    got = {(r["query_id"], r["media_id"]): (r["decode_idx"], r["processed"], r["asked"]) for r in lazily.first_visible(offered, lines, connectors).collect()}
    assert got == {(1 + m % 2, m): (10 + 10 * (m % 3), 2 + m % 3, 3 if m % 3 < 2 else 5) for m in range(30)}
    assert compared == [2, 4, 4]
