from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from echoline import service, sinks

RESULT = "query_id long, media_id long, matched_text string, start double, end double, match_type string, score double, occurrence_count int, frame_index int, frame_timestamp double, localization_source string, verification_source string, confidence string, confidence_reason string, audio_processed_seconds double"


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([(1, 7, "open the door", 1.0, 2.0, "exact", 100.0, 2, 3, 1.1, "caption", "asr", "HIGH", "both", 4.0)], RESULT)


@pytest.fixture(scope="module")
def images(spark, results):
    return sinks.frame_images(results, spark.createDataFrame([(7, 3, bytearray(b"three")), (7, 4, bytearray(b"four"))], "media_id long, decode_idx int, image binary"))


def runs(results):
    def run(url, line):
        if line == "boom":
            raise RuntimeError("Could not download media")
        return results if line == "open the door" else results.limit(0)

    return run


@pytest.mark.parametrize(("request_", "status", "code"), [
    ({}, 422, "VIDEO_URL_REQUIRED"), ({"video_url": " ", "dialogue": "x"}, 422, "VIDEO_URL_REQUIRED"), ({"video_url": 5, "dialogue": "x"}, 422, "VIDEO_URL_REQUIRED"), ({"video_url": "ftp://a/b", "dialogue": "x"}, 422, "INVALID_VIDEO_URL"),
    ({"video_url": "https://a.example/b", "dialogue": "  "}, 422, "DIALOGUE_REQUIRED"), ({"video_url": "https://a.example/b", "dialogue": "absent"}, 404, "DIALOGUE_NOT_FOUND"), ({"video_url": "https://a.example/b", "dialogue": "boom"}, 422, "VIDEO_UNAVAILABLE"),
])
def test_faults(spark, results, request_, status, code):
    got = service.find(spark, request_, runs(results))
    assert (got[0], got[1]["error"]["code"]) == (status, code)


def test_server(spark, results, images):
    server = service.serve(spark, runs(results), images, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert json.load(urllib.request.urlopen(f"{base}/api/health")) == {"status": "ok"}
        body = json.dumps({"video_url": "<https://a.example/b>", "dialogue": "open the door"}).encode()
        found = json.load(urllib.request.urlopen(urllib.request.Request(f"{base}/api/find", body)))
        assert found["match"]["matched_text"] == "open the door"
        assert found["evidence"]["confidence"] == "HIGH"
        frame_id = images.first()["frame_id"]
        assert urllib.request.urlopen(f"{base}/api/frames/{frame_id}").read() == b"three"
        for path in ("/api/frames/..%2fetc", f"/api/frames/{'0' * 32}", "/other"):
            with pytest.raises(urllib.error.HTTPError, match="404"):
                urllib.request.urlopen(base + path)
        with pytest.raises(urllib.error.HTTPError, match="422"):
            urllib.request.urlopen(urllib.request.Request(f"{base}/api/find", b"not json"))
    finally:
        server.shutdown()
        server.server_close()


def test_images_are_published(spark, images, tmp_path):
    """Earlier images of the same media and unfinished ones go; files of others stay."""
    folder = tmp_path / "frames"
    folder.mkdir()
    stale, part, other, foreign = f"7-{'a' * 32}.png", f"7-{'b' * 32}.png.part", f"8-{'a' * 32}.png", "7-notes.png"
    for name in (stale, part, other, foreign):
        (folder / name).write_bytes(b"old")
    for _ in range(2):
        rows = sinks.publish_images(images, str(tmp_path)).collect()
        assert [(r["media_id"], r["frame_index"], r["path"]) for r in rows] == [(7, 3, f"{folder}/7-{rows[0]['frame_id']}.png")]
        left = {f.name for f in folder.iterdir() if not f.name.endswith(".crc")}
        assert left == {other, foreign, f"7-{rows[0]['frame_id']}.png"}
        assert (folder / f"7-{rows[0]['frame_id']}.png").read_bytes() == b"three"
    assert sinks.publish_images(images.where(F.lit(False)), str(tmp_path)).count() == 0


def test_published_folders_do_not_grow_with_media(spark, tmp_path):
    path, rows = f"{tmp_path}/out", spark.range(300).select(F.col("id").alias("media_id"), F.lit("first").alias("run"))
    sinks.write(rows, path)
    sinks.write(rows.where("media_id % 3 = 0").withColumn("run", F.lit("second")).withColumn("more", F.lit(1)), path)
    assert len([f for f in (tmp_path / "out").iterdir() if f.is_dir()]) <= 64
    got = sorted((r["media_id"], r["run"]) for r in spark.read.parquet(path).collect())
    assert got == [(k, "second" if k % 3 == 0 else "first") for k in range(300)]
