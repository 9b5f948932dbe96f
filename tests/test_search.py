from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from echoline import cli, schemas, sinks
from echoline.config import SearchConfig
from echoline.functions import rules
from echoline.operators import cache, frames, intervals, occurrences, verify
from echoline.plans import search
from echoline.sources.connectors import Connectors


def words_table(spark, *lines):
    """lines: (media_id, model, start, text); a word lasts half a second."""
    rows = []
    for media_id, model, start, text in lines:
        at = sum(r[0] == media_id and r[1] == model for r in rows)
        rows += [(media_id, model, at + k, w, start + k * 0.5, start + (k + 1) * 0.5, 0.9) for k, w in enumerate(text.split())]
    return spark.createDataFrame(rows, schemas.WORDS)


CANDIDATE = "query_id long, media_id long, source string, language string, rank int, text string, start double, end double, match_type string, score double"
MEDIA = "media_id long, duration double, audio_start_time double"


def verified(spark, candidates, words, target, margins, media=((1, None, 0.0),), **more):
    rows = [(1, 1, "manual", "en", k, "c", s, e, "exact", 100.0) for k, (s, e) in enumerate(candidates, 1)]
    return verify.verify(spark.createDataFrame(rows, CANDIDATE), spark.createDataFrame(list(media), MEDIA), words, spark.createDataFrame([(1, target)], schemas.TARGETS), margins=margins, **more).first()


def test_widening_windows(spark):
    words = words_table(spark, (1, "base", 7.0, "my mind rebels at stagnation"), (1, "base", 11.0, "something else entirely here"))
    got = verified(spark, [(10.0, 12.0)], words, "my mind rebels at stagnation", (1.0, 3.0))
    assert (got["verified"], got["audio_processed_seconds"], got["start"], got["window_start"]) == (True, 12.0, 7.0, 7.0)


def test_first_candidate_ends_the_search(spark):
    words = words_table(spark, (1, "base", 2.0, "come here"), (1, "base", 10.0, "come here"))
    got = verified(spark, [(2.0, 3.0), (10.0, 11.0)], words, "come here", (0.0,))
    assert (got["start"], got["audio_processed_seconds"]) == (2.0, 1.0)


def test_second_candidate_and_clamping(spark):
    words = words_table(spark, (1, "base", 10.0, "my mind rebels at"))
    got = verified(spark, [(2.0, 3.0), (10.0, 12.0)], words, "my mind rebels at", (0.0,), media=((1, 12.0, 0.5),))
    assert (got["start"], got["audio_processed_seconds"]) == (10.5, 3.0)
    none = verified(spark, [(2.0, 3.0), (2.0, 3.0)], words, "my mind rebels at", (0.0, 1.0), media=((1, 2.0, 0.0),))
    assert (none["verified"], none["audio_processed_seconds"]) == (False, 1.0)


def test_precision_pass_counts_twice(spark):
    base, better = words_table(spark, (1, "base", 9.0, "is it looking bali")), words_table(spark, (1, "large", 9.0, "how's it looking barley"))
    got = verified(spark, [(10.0, 12.0)], base, "How's it looking, Barley?", (2.0,), precision_words=better)
    assert (got["verified"], got["audio_processed_seconds"], got["passes"], got["score"]) == (True, 12.0, 2, 100.0)
    assert got["base_score"] == pytest.approx(78.0487804878)


def test_gate(spark):
    df = spark.createDataFrame([(45.0, True), (44.999, False), (85.0, False), (None, True)], "s double, wanted boolean")
    assert all(r["got"] == r["wanted"] for r in df.withColumn("got", verify.gate(F.col("s"), 45.0, 85.0)).collect())
    assert spark.range(1).select(verify.gate_reason(F.lit(1.0), 45.0)).first()[0] == "base_match_score_below_precision_trigger"


FRAME_ROWS = "media_id long, decode_idx int, pts long, timestamp double"


@pytest.mark.parametrize(("pts", "at", "wanted"), [([1000, 1350, 2100], 1.4, 2100), ([1000, 1400, 2100], 1.4, 1400), ([None, 10000, 10500, 11100], 10.5, 10500), ([1000], 1.4, None)])
def test_frame_resolution(spark, pts, at, wanted):
    rows = spark.createDataFrame([(1, k, p, None if p is None else p / 1000) for k, p in enumerate(pts)], FRAME_ROWS)
    got = frames.first_frame_at(spark.createDataFrame([(1, 1, at)], "query_id long, media_id long, start double"), rows).first()
    assert got["decode_idx"] == (None if wanted is None else pts.index(wanted))
    assert frames.sample_frame(rows).first()["pts"] == pts[0]


def test_frame_seconds(spark):
    assert spark.range(1).select(frames.frame_seconds(F.lit(9009), F.lit("1/90000"))).first()[0] == pytest.approx(0.1001)


def test_as_of_against_a_scan(spark):
    rng = random.Random(3)
    events = [(k, rng.randint(0, 2), rng.randint(0, 4000) / 10) for k in range(300)]
    points = [(k, rng.randint(0, 2), rng.randint(0, 4000) / 10) for k in range(60)]
    got = intervals.as_of_forward(spark.createDataFrame(events, "e long, m int, at double"), spark.createDataFrame(points, "p long, m int, ts double"), ["m"], "at", "ts", "p", bucket=7.0, order="p").collect()
    assert len(got) == 300
    for r in got:
        later = sorted((t, p) for p, m, t in points if m == r["m"] and t + 1e-9 >= r["at"])
        assert (r["ts_found"], r["p"]) == (later[0] if later else (None, None))


def test_interval_join_against_a_scan(spark):
    rng = random.Random(4)
    spans = [(k, rng.randint(0, 2), a := rng.uniform(0, 100), a + rng.uniform(-1, 30)) for k in range(80)]
    points = [(k, rng.randint(0, 2), a := rng.uniform(0, 100), a + rng.uniform(0, 5)) for k in range(80)]
    got = intervals.interval_join(spark.createDataFrame(spans, "s long, m int, low double, high double"), spark.createDataFrame(points, "p long, m int, a double, b double"), ["m"], "low", "high", "a", "b", bucket=9.0)
    assert sorted((r["s"], r["p"]) for r in got.collect()) == sorted((s, p) for s, m, lo, hi in spans for p, n, a, b in points if m == n and a >= lo and b <= hi)


def test_visible_text(spark):
    assert frames.visible_match("my mind rebels at stagnation", "my mind rebels at stagnation", 85.0)[1:] == ("exact", 100.0)
    assert frames.visible_match("open ai", "so openai", 85.0)[1] in ("exact", "fuzzy")
    assert frames.visible_match("my mind rebels at stagnation", "my mind rebeis at stagnation", 85.0)[1] == "fuzzy"
    assert frames.visible_match("my mind", "nothing", 85.0) is None
    shown = ["MY", "MY MIND", "MY MIND rebels,  at stagnation!", "MY MIND rebels at stagnation"]
    lines = spark.createDataFrame([(1, k, j, t, 0.9) for k, text in enumerate(shown) for j, t in enumerate([text, " "])], schemas.OCR_LINES)
    targets = spark.createDataFrame([(1, "my mind rebels at stagnation"), (2, "another line altogether")], schemas.TARGETS)
    offered = spark.createDataFrame([(q, 1, k) for q in (1, 2) for k in range(4)], "query_id long, media_id long, decode_idx int")
    got = {r["query_id"]: r for r in frames.first_visible(offered, frames.visible_text(frames.frame_texts(lines), targets)).collect()}
    assert (got[1]["decode_idx"], got[1]["processed"], got[1]["match_type"]) == (2, 3, "exact")
    assert (got[2]["decode_idx"], got[2]["processed"]) == (None, 4)


@pytest.mark.parametrize(("given", "wanted"), [
    (("caption", "asr", "exact", 100.0, "exact", 100.0, None, None, False), "HIGH"), (("caption", "asr", "exact", 100.0, "fuzzy", 90.0, None, None, False), "MEDIUM"), (("asr", "ocr", "exact", 100.0, None, None, "exact", 100.0, False), "HIGH"),
    (("asr", "ocr", "exact", 100.0, None, None, "fuzzy", 90.0, False), "MEDIUM"), (("asr", "asr", "exact", 100.0, None, None, None, None, False), "MEDIUM"), (("asr", "asr", "fuzzy", 91.0, None, None, None, None, False), "LOW"),
    (("caption", "asr", "exact", 100.0, "exact", 100.0, None, None, True), "LOW"), (("asr", "ocr", "exact", 100.0, None, None, "exact", 72.0, False), "LOW"), (("caption", "asr", "exact", 84.9, "exact", 100.0, None, None, None), "LOW"),
])
def test_confidence(spark, given, wanted):
    df = spark.createDataFrame([given], "a string, b string, c string, d double, e string, f double, g string, h double, i boolean")
    assert df.select(rules.confidence(*[F.col(c) for c in "abcdefghi"])["category"]).first()[0] == wanted


def test_errors(spark):
    df = spark.createDataFrame([(False, True, "missing_video_stream"), (True, False, "missing_audio_stream"), (False, False, "missing_video_stream"), (True, True, None)], "v boolean, a boolean, wanted string")
    got = df.withColumn("m", rules.stream_error(F.col("v"), F.col("a"))).withColumn("code", F.when(F.col("m").isNotNull(), rules.error_stage(F.col("m"))["code"]))
    assert all(r["code"] == r["wanted"] for r in got.collect())
    assert spark.range(1).select(rules.error_stage(F.lit("dialogue not found"), F.lit("mine"), F.lit(""))).first()[0].asDict() == {"code": "mine", "stage": "matching"}


def test_config():
    assert SearchConfig().margins == (2.0, 5.0)
    for bad in ({"margins": (2.0, 2.0)}, {"margins": (5.0, 2.0)}, {"margins": ()}, {"precision_trigger": 90.0}, {"precision_full_audio": True, "precision_fallback": False}, {"caption_threshold": 101}, {"cue_window": 0}, {"frame_margin": -1}):
        with pytest.raises(ValueError, match=r"."):
            SearchConfig(**bad)


def test_memo(spark, tmp_path):
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, key string")
    rows = cache.envelope(requests.where("id < 3"), "key", ["id"], "transcript").withColumn("schema_version", F.when(F.col("key") == "b", 0).otherwise(F.col("schema_version")))
    assert cache.write(rows, str(tmp_path / "memo"))
    assert not cache.write(rows, "nowhere://x")
    hits, misses = cache.hits_and_misses(requests, cache.read(spark, str(tmp_path / "memo")), "key", "transcript")
    assert [r["id"] for r in hits.collect()] == [1]
    assert sorted(r["id"] for r in misses.collect()) == [2, 3]
    assert cache.identity("base", {"b": "1", "a": "2"}, "int8", None, "plain") == "base|a=2|b=1|int8|auto|plain"


def test_captions_first_then_speech(spark):
    cues = spark.createDataFrame([(1, "manual", "en", 0, "My mind rebels at stagnation", 9.0, 12.0), (2, "manual", "en", 0, "my mind rebels at stagnation", 50.0, 52.0), (3, "automatic", "en", 0, "my mind rebels at stagnation", 20.0, 22.5)], schemas.CUES)
    words = words_table(spark, (1, "base", 9.0, "my mind rebels at stagnation"), (2, "base", 2.0, "my mind rebels at stagnation"), (3, "base", 20.0, "my mind revels at stagnation"))
    media = spark.createDataFrame([(1, 100.0, 0.0), (2, 60.0, 1.0), (3, None, None)], MEDIA)
    targets = spark.createDataFrame([(7, "My mind rebels at stagnation.")], schemas.TARGETS)
    frame_table = spark.createDataFrame([(m, k, None, k * 0.75) for m in (1, 2, 3) for k in range(60)], FRAME_ROWS)
    results = search.search(cues, words, targets, media, frame_table)
    got = {r["media_id"]: r for r in results.collect()}
    assert (got[1]["localization_source"], got[1]["confidence"], got[1]["start"], got[1]["frame_index"]) == ("caption", "HIGH", 9.0, 12)
    assert (got[2]["localization_source"], got[2]["start"], got[2]["audio_processed_seconds"], got[2]["confidence"]) == ("asr", 3.0, 60.0 + 6.0 + 12.0, "MEDIUM")
    assert (got[3]["localization_source"], got[3]["match_type"], got[3]["confidence"]) == ("caption", "fuzzy", "MEDIUM")
    lines = spark.createDataFrame([(1, 13, 0, "MY MIND", 0.9), (1, 13, 1, "rebels at stagnation", 0.9)], schemas.OCR_LINES)
    seen = {r["media_id"]: r for r in search.search_visible(results, frame_table, lines, targets).collect()}
    assert (seen[1]["frame_match_type"], seen[1]["frame_index"], seen[1]["verification_source"], seen[1]["confidence"]) == ("visible_text", 13, "ocr", "HIGH")
    assert (seen[2]["frame_match_type"], seen[2]["verification_source"]) == ("spoken_dialogue", "asr")
    flat = {r["media_id"]: r for r in sinks.report(search.search_visible(results, frame_table, lines, targets), targets, visible=True).collect()}
    assert (flat[1]["dialogue_start_hms"], flat[1]["query"], flat[1]["match_score"], flat[1]["asr_model_used"], flat[1]["occurrence_count"]) == ("00:00:09.000", "My mind rebels at stagnation.", 100.0, "base.en", 1)
    assert len(set(flat[1].asDict()) - {"query_id", "media_id"}) == 42 + len(sinks.VISIBLE) + 1
    assert '"frame_path":null' in sinks.as_json(sinks.report(results, targets)).first()["json"]
    images = spark.createDataFrame([(1, 12, bytearray(b"png")), (1, 13, bytearray(b"other"))], "media_id long, decode_idx int, image binary")
    assert [(r["frame_index"], len(r["frame_id"])) for r in sinks.frame_images(results, images).collect()] == [(12, 32)]
    assert search.response(results).where("media_id = 1").first()["match"]["score"] == 100.0


def test_speech_only_and_inspection(spark):
    words = words_table(spark, (1, "base", 2.0, "come here now and come here again"))
    got = search.search_speech(words, spark.createDataFrame([(1, "come here")], schemas.TARGETS)).first()
    assert (got["occurrence_count"], got["start"], got["match_type"]) == (2, 2.0, "exact")
    media = spark.createDataFrame([(1, 5.0, True, True), (2, None, False, True)], "media_id long, duration double, has_video boolean, has_audio boolean")
    rows = {r["media_id"]: r for r in search.inspect(media, spark.createDataFrame([(1, 3, 0, "1/25", 0.12)], "media_id long, decode_idx int, pts long, time_base string, timestamp double")).collect()}
    assert (rows[1]["frame_index"], rows[1]["error"], rows[1]["duration_hms"]) == (3, None, "00:00:05.000")
    assert "video stream" in rows[2]["error"]
    assert occurrences.transcripts(words).first()["words"][0]["text"] == "come"


def test_processed_seconds(spark):
    words = words_table(spark, (1, "base", 2.0, "come here"), (2, "base", 0.0, "a"))
    media = spark.createDataFrame([(1, None), (2, 9.0), (3, None)], "media_id long, duration double")
    assert {r["media_id"]: r["audio_processed_seconds"] for r in verify.processed_seconds(media, words, 2).collect()} == {1: 6.0, 2: 18.0, 3: 0.0}


def test_full_audio_precision(spark):
    cues = spark.createDataFrame([], schemas.CUES)
    base, better = words_table(spark, (1, "base", 9.0, "is it looking bali")), words_table(spark, (1, "large", 9.0, "how's it looking barley"))
    targets, media = spark.createDataFrame([(1, "How's it looking, Barley?")], schemas.TARGETS), spark.createDataFrame([(1, 30.0, 0.0)], MEDIA)
    assert search.search(cues, base, targets, media, None, SearchConfig(), better).count() == 0
    got = search.search(cues, base, targets, media, None, SearchConfig(precision_full_audio=True), better).first()
    assert (got["match_type"], got["audio_processed_seconds"]) == ("exact", 60.0)


def test_cli(spark, tmp_path, capsys):
    words_table(spark, (1, "base", 2.0, "come here now")).write.parquet(f"{tmp_path}/words")
    spark.createDataFrame([(1, "come here")], schemas.TARGETS).write.parquet(f"{tmp_path}/targets")
    spark.createDataFrame([(1, 30.0, 0.0)], MEDIA).write.parquet(f"{tmp_path}/media")
    args = [x for n in ("words", "targets", "media") for x in (f"--{n}", f"{tmp_path}/{n}")]
    assert cli.main(args, spark) == 0
    assert '"matched_text":"come here"' in capsys.readouterr().out
    assert cli.main([*args, "--output", f"{tmp_path}/out"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/out").first()["dialogue_start"] == 2.0
    assert cli.main([*args[:-1], f"{tmp_path}/none"], spark) == 1
    assert '"error_code"' in capsys.readouterr().err
    assert cli.main([*args, "--margin", "5", "--margin", "2"], spark) == 1


def test_live_captions(spark, tmp_path):
    from echoline import streaming

    rows = [(1, "well come here now", "2024-01-01 00:00:00"), (1, "nothing", "2024-01-01 00:00:30"), (2, "Come here!", "2024-01-01 00:07:00"), (2, "Come here!", "2024-01-01 00:07:00")]
    spark.createDataFrame(rows, "media_id long, text string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("media_id long, text string, at timestamp").parquet(f"{tmp_path}/in")
    hits = streaming.live_phrases(live, spark.createDataFrame([(5, "come here")], schemas.TARGETS))
    hits.writeStream.format("memory").queryName("hits").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["query_id"], r["media_id"]) for r in spark.table("hits").collect()) == [(5, 1), (5, 2)]


def clip_case(spark, tmp_path):
    """Three candidates for a line in two media; only some windows hold it."""
    candidates = spark.createDataFrame([(1, m, "manual", "en", f"cue {r}", 10.0 * r, 10.0 * r + 2, "fuzzy", 90.0, r) for m in (1, 2) for r in (1, 2, 3, 4, 5)], "query_id long, media_id long, source string, language string, text string, start double, end double, match_type string, score double, rank int")
    media = spark.createDataFrame([(1, 100.0, 0.5), (2, 100.0, None)], "media_id long, duration double, audio_start_time double")
    targets = spark.createDataFrame([(1, "open the door")], "query_id long, text string")
    log = tmp_path / "log"
    log.mkdir()

    def recogniser():
        def one(row):
            with (log / f"{uuid.uuid4().hex}").open("w") as f:
                f.write(f"{row['media_id']} {row['window_start']}")
            here = row["media_id"] == 1 and row["window_start"] <= 21 <= row["window_end"]
            said = ["please", "open", "the", "door"] if here else ["nothing", "here"]
            return [{"media_id": row["media_id"], "window_start": row["window_start"], "window_end": row["window_end"], "word_idx": k, "text": w, "start": 20.0 + k * 0.2, "end": 20.2 + k * 0.2} for k, w in enumerate(said)]

        return one

    return candidates, media, targets, Connectors().register("recognise_window", recogniser), lambda: sorted(f.read_text() for f in log.iterdir())


def test_windows_are_recognised_themselves(spark, tmp_path):
    """A recogniser hears the recordings of the windows: in rounds, so not all of them, and each once with a memo."""
    candidates, media, targets, connectors, asked = clip_case(spark, tmp_path)
    hear = verify.by_connector(connectors, memo=str(tmp_path / "memo"), identity="base.en")
    got = {r["media_id"]: r for r in verify.verify(candidates, media, hear, targets, margins=(1.0,)).collect()}
    assert (got[1]["verified"], got[1]["caption_text"], got[1]["matched_text"], got[1]["start"], got[1]["audio_processed_seconds"]) == (True, "cue 2", "open the door", pytest.approx(20.7), 8.0)
    assert (got[2]["verified"], got[2]["audio_processed_seconds"]) == (False, 20.0)
    first = asked()
    assert len(first) == len(set(first))
    assert sum(x.startswith("1 ") for x in first) == 3  # the first window, then the next two
    assert sum(x.startswith("2 ") for x in first) == 5
    again = {r["media_id"]: r["matched_text"] for r in verify.verify(candidates, media, verify.by_connector(connectors, memo=str(tmp_path / "memo"), identity="base.en"), targets, margins=(1.0,)).collect()}
    assert again == {1: "open the door", 2: None}
    assert asked() == first
    verify.verify(candidates, media, verify.by_connector(connectors, memo=str(tmp_path / "memo"), identity="other"), targets, margins=(1.0,)).collect()
    assert len(asked()) == 2 * len(first)


def test_precise_recogniser_is_asked_late(spark, tmp_path):
    """Only windows that the base words leave open and the gate lets through reach the precise recogniser."""
    candidates, media, targets, connectors, asked = clip_case(spark, tmp_path)
    words = spark.createDataFrame([(1, k, w, 20.0 + k * 0.2, 20.2 + k * 0.2) for k, w in enumerate(["open", "a", "drawer"])], "media_id long, word_idx int, text string, start double, end double")
    got = {r["media_id"]: r for r in verify.verify(candidates, media, words, targets, margins=(1.0,), precision_words=verify.by_connector(connectors)).collect()}
    assert (got[1]["matched_text"], got[1]["passes"], got[1]["score"]) == ("open the door", 2, 100.0)
    assert 45 <= got[1]["base_score"] < 85
    assert "1 19.0" in asked()


CLIPS = """
from echoline.sources.connectors import Connectors


def make(options):
    def factory():
        def hear(row):
            said = ["come", "here"] if row["window_start"] <= 4 else ["silence"]
            return [{"media_id": row["media_id"], "window_start": row["window_start"], "window_end": row["window_end"], "word_idx": k, "text": w, "start": 4.0 + k, "end": 4.5 + k} for k, w in enumerate(said)]

        return hear

    assert (options.device, options.compute_type, options.cookies) == ("cpu", "int8", None)
    return Connectors().register("recognise_window", factory)
"""


def test_cli_with_connectors_and_images(spark, tmp_path, monkeypatch):
    """Captions verified by a connector on the windows themselves: the table of words holds nothing of the line."""
    (tmp_path / "clip_connectors.py").write_text(CLIPS)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "clip_connectors.py"))
    words_table(spark, (1, "base", 2.0, "nothing at all")).write.parquet(f"{tmp_path}/words")
    spark.createDataFrame([(1, "come here")], schemas.TARGETS).write.parquet(f"{tmp_path}/targets")
    spark.createDataFrame([(1, 30.0, 0.0)], MEDIA).write.parquet(f"{tmp_path}/media")
    spark.createDataFrame([(1, "manual", "en", 0, "Come here!", 4.0, 6.0), (1, "manual", "en", 1, "Come here!", 20.0, 22.0)], "media_id long, source string, language string, cue_idx int, text string, start double, end double").write.parquet(f"{tmp_path}/cues")
    spark.createDataFrame([(1, k, None, float(k)) for k in range(30)], "media_id long, decode_idx int, pts long, timestamp double").write.parquet(f"{tmp_path}/frames")
    spark.createDataFrame([(1, k, bytearray(b"%d" % k)) for k in range(30)], "media_id long, decode_idx int, image binary").write.parquet(f"{tmp_path}/images")
    args = [x for n in ("words", "targets", "media", "cues", "frames", "images") for x in (f"--{n}", f"{tmp_path}/{n}")]
    assert cli.main([*args, "--connectors", "clip_connectors:make", "--cache", f"{tmp_path}/memo", "--output", f"{tmp_path}/out"], spark) == 0
    row = spark.read.parquet(f"{tmp_path}/out").first()
    assert (row["dialogue_start"], row["localization_source"], row["frame_index"]) == (4.0, "caption", 4)
    published = [f for f in (tmp_path / "out-images" / "frames").iterdir() if f.suffix == ".png"]
    assert [f.read_bytes() for f in published] == [b"4"]
    assert cache.read(spark, f"{tmp_path}/memo/windows").count() >= 1
