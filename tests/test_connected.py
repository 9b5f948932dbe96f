from __future__ import annotations

import json
import struct

import pytest

from echoline.plans import connected
from echoline.sources.connectors import Connectors, align

RATE = 10
#: What is said in each medium, as (word, start, end).
SPEECH = {
    1: [("bring", 5.0, 5.5), ("the", 5.5, 6.0), ("copper", 6.0, 6.5), ("lantern", 6.5, 7.0)],
    2: [("nobody", 1.0, 1.5), ("came", 1.5, 2.0), ("bring", 8.0, 8.5), ("the", 8.5, 9.0), ("copper", 9.0, 9.5), ("lantern", 9.5, 10.0)],
    3: [("seven", 3.0, 3.5), ("swans", 3.5, 4.0), ("crossed", 4.0, 4.5)],
    4: [("quiet", 1.0, 2.0)],
}
LINES = [(10, "Bring the copper lantern"), (11, "seven swans crossed")]


def vtt(*cues):
    return "WEBVTT\n\n" + "\n\n".join(f"00:00:{s:06.3f} --> 00:00:{e:06.3f}\n{t}" for t, s, e in cues)


CAPTIONS = {1: vtt(("Bring the copper lantern!", 5.0, 7.0)), 2: vtt(("something else", 1.0, 2.0)), 3: "<html>no</html>"}


@pytest.fixture
def world(spark, tmp_path):
    """(media, connectors, calls by role): everything outside answers from SPEECH and CAPTIONS and notes that it was asked."""
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = []
    for m in SPEECH:
        data = bytes(200)
        (tmp_path / f"{m}.wav").write_bytes(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(data)) + data)
        rows.append((m, "/nowhere" if m % 2 else str(tmp_path / f"{m}.wav"), str(tmp_path / f"{m}.wav")))
    media = spark.createDataFrame(rows, "media_id long, remote_path string, path string")

    def role(name, answer):
        def factory():
            import uuid

            def one(row):
                (calls / f"{name}-{row['media_id']}-{uuid.uuid4().hex}").touch()
                return answer(row)

            return one

        return factory

    def inspect(row):
        m = row["media_id"]
        tracks = {"en": [{"ext": "vtt", "url": f"https://e.test/{m}.vtt"}, {"ext": "srt", "url": f"https://e.test/{m}.srt"}]} if m in CAPTIONS else {}
        return [{"media_id": m, "metadata": json.dumps({"language": "en", "subtitles": tracks}), "video_url": None, "video_headers": {}}]

    def hear(row):
        found = [w for w in SPEECH[row["media_id"]] if w[1] >= row["window_start"] and w[2] <= row["window_end"]]
        assert len(row["audio"]) == min(200, -int(-row["window_end"] * RATE // 1)) - int(row["window_start"] * RATE) and row["begins"] <= row["window_start"]
        return [{**{c: row[c] for c in ("media_id", "window_start", "window_end")}, "word_idx": k, "text": t, "start": s, "end": e} for k, (t, s, e) in enumerate(found)]

    def realign(row):
        if row["media_id"] == 2:
            raise RuntimeError("no model for this language")
        return [{"media_id": row["media_id"], "model": row["model"], "word_idx": w["word_idx"], "text": w["text"], "start": w["start"] + 0.125, "end": w["end"], "probability": None, "error": None} for w in row["words"]]

    c = Connectors()
    c.register("inspect", role("inspect", inspect))
    c.register("probe", role("probe", lambda row: [{"media_id": row["media_id"], "probe": json.dumps({"format": {"duration": "20"}, "streams": [{"codec_type": "audio", "start_time": "0.5"}, {"codec_type": "video"}]})}]))
    c.register("fetch_subtitle", role("fetch", lambda row: [{"media_id": row["media_id"], "source": row["source"], "language": row["language"], "extension": row["extension"], "content": CAPTIONS[row["media_id"]] if row["extension"] == "vtt" else "<html>", "rate_limited": False}]))
    c.register("recognise_window", role("window", hear))
    c.register("transcribe", role("transcribe", lambda row: [{"media_id": row["media_id"], "model": "base.en", "word_idx": k, "text": t, "start": s, "end": e, "probability": 0.9} for k, (t, s, e) in enumerate(SPEECH[row["media_id"]])]))
    c.register("align", role("align", realign))
    c.register("decode_frames", role("decode", lambda row: [{"media_id": row["media_id"], "decode_idx": k, "pts": k, "time_base": "1/2", "timestamp": k * 0.5, "image_digest": f"{row['media_id']}-{k // 4}"} for k in range(40)]))
    c.register("read_text", role("read", lambda row: [{"media_id": row["media_id"], "decode_idx": row["decode_idx"], "line_idx": 0, "text": "BRING THE COPPER LANTERN" if row["image_digest"] == "2-4" else "noise", "confidence": 0.9}]))

    def asked(name):
        return sorted(int(p.name.split("-")[1]) for p in calls.glob(f"{name}-*"))

    return media, c, asked


def test_everything_from_addresses(spark, world):
    media, connectors, asked = world
    targets = spark.createDataFrame(LINES, "query_id long, text string")
    found = connected.search_media(media, targets, connectors)
    got = {(r["query_id"], r["media_id"]): r for r in found.results.collect()}
    assert set(got) == {(10, 1), (10, 2), (11, 3)}
    caption = got[10, 1]
    assert (caption["localization_source"], caption["start"], caption["end"], caption["caption_match_type"]) == ("caption", 5.5, 7.5, "exact")  # moved by the start of the audio
    assert (caption["frame_index"], caption["frame_match_type"]) == (11, "spoken_dialogue")
    speech = got[10, 2]
    assert (speech["localization_source"], speech["start"], speech["matched_text"]) == ("asr", 8.5, "bring the copper lantern")
    assert (speech["frame_match_type"], speech["frame_index"], speech["ocr_match_type"]) == ("visible_text", 16, "exact")
    assert got[11, 3]["start"] == 3.625  # with the aligner's time
    attempts = {(r["media_id"], r["track_rank"]): r["outcome"] for r in found.attempts.collect()}
    assert attempts == {(1, 1): "parsed", (2, 1): "parsed", (3, 1): "unusable", (3, 2): "unusable"}
    assert asked("fetch") == [1, 2, 3, 3]
    assert asked("window") == [1] * len(asked("window")) and asked("window")
    assert asked("transcribe") == [1, 2, 3, 4]  # each has an open pair
    assert asked("align") == [1, 2, 3, 4]
    reasons = {r["media_id"]: (r["alignment_source"], r["precision_fallback_reason"]) for r in found.words[0].select("media_id", "alignment_source", "precision_fallback_reason").distinct().collect()}
    assert reasons == {1: ("whisperx", None), 2: ("faster-whisper", "no model for this language"), 3: ("whisperx", None), 4: ("whisperx", None)}
    assert asked("read").count(2) < 10  # of the images near the match, each once
    before = {r: len(asked(r)) for r in ("inspect", "fetch", "transcribe", "window", "read")}
    found.results.count()
    assert before == {r: len(asked(r)) for r in before}  # nobody is asked twice


def test_answered_media_are_not_transcribed(spark, world):
    media, connectors, asked = world
    targets = spark.createDataFrame(LINES[:1], "query_id long, text string")
    found = connected.search_media(media.where("media_id IN (1, 4)"), targets, connectors)
    assert {(r["query_id"], r["media_id"]) for r in found.results.collect()} == {(10, 1)}
    assert asked("transcribe") == [4]


def test_media_are_probed_once(spark, world, tmp_path):
    media, connectors, asked = world
    memo = str(tmp_path / "memo")
    first = {r["media_id"]: r["probe"] for r in connected.probed(media.where("media_id < 3"), connectors, memo, "v1").collect()}
    again = {r["media_id"]: r["probe"] for r in connected.probed(media, connectors, memo, "v1").collect()}
    assert set(first) == {1, 2} and set(again) == {1, 2, 3, 4} and asked("probe") == [1, 2, 3, 4]
    connected.probed(media.where("media_id = 1"), connectors, memo, "v2").collect()
    assert asked("probe") == [1, 1, 2, 3, 4]


def test_faults_of_an_aligner_are_told(spark):
    words = spark.createDataFrame([(m, "base", k, "w", k * 1.0, k + 1.0, 0.5) for m in (1, 2) for k in range(2)], "media_id long, model string, word_idx int, text string, start double, end double, probability double")

    def factory():
        def one(row):
            if row["media_id"] == 2:
                raise KeyError()
            return [{"media_id": 1, "model": "base", "word_idx": w["word_idx"], "start": 9.0, "end": 9.5} for w in row["words"]]

        return one

    got = {(r["media_id"], r["word_idx"]): (r["start"], r["precision_fallback_reason"]) for r in align(words, Connectors().register("align", factory)).collect()}
    assert got == {(1, 0): (9.0, None), (1, 1): (9.0, None), (2, 0): (0.0, "KeyError"), (2, 1): (1.0, "KeyError")}
    with pytest.raises(ValueError, match="can't tell faults"):
        Connectors().register("probe", factory).run("probe", words, keep_going=True)
