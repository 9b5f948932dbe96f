"""A thin HTTP service over results: POST /api/find, GET /api/health, GET /api/frames/<id>.

The service holds no logic of its own: `find` maps a request to a status and an answer, the handler moves bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.functions import rules
from echoline.plans import search
from echoline.sources import urls

#: Messages of the public codes.
MESSAGES = {"VIDEO_URL_REQUIRED": "Enter a video URL.", "INVALID_VIDEO_URL": "Enter a valid public video URL.", "DIALOGUE_REQUIRED": "Enter the line to find.", "DIALOGUE_NOT_FOUND": "The line was not found.", "VIDEO_UNAVAILABLE": "The video can't be read.", "PROCESSING_FAILED": "The search failed."}

Search = Callable[[str, str], DataFrame]


def fault(spark: SparkSession, code: str) -> tuple[int, dict]:
    status = spark.range(1).select(rules.public_status(F.lit(code)).alias("s")).first()["s"]
    return status or 500, {"error": {"code": code, "message": MESSAGES.get(code, MESSAGES["PROCESSING_FAILED"])}}


def find(spark: SparkSession, request: dict, run: Search) -> tuple[int, dict]:
    """(status, answer) for {"video_url": ..., "dialogue": ...}; run(url, line) gives the results as a table."""
    text = lambda name: request.get(name) if isinstance(request.get(name), str) else None
    asked = spark.createDataFrame([(text("video_url"), text("dialogue"))], "url string, line string").withColumn("clean", urls.clean(F.col("url")))
    checked = asked.select("clean", rules.request_error(F.col("url"), F.col("line"), urls.is_public(F.col("clean"))).alias("code")).first()
    if checked["code"]:
        return fault(spark, checked["code"])
    try:
        found = search.response(run(checked["clean"], request["dialogue"])).limit(1).toJSON().collect()
    except Exception as problem:
        code = spark.range(1).select(rules.public_code(F.lit(str(problem))).alias("c")).first()["c"]
        return fault(spark, code)
    return (200, json.loads(found[0])) if found else fault(spark, "DIALOGUE_NOT_FOUND")


def frame(images: DataFrame, frame_id: str) -> bytes | None:
    """The image under an opaque id of 32 hexadecimal digits (rows of `sinks.frame_images`)."""
    if not re.fullmatch(r"[0-9a-f]{32}", frame_id):
        return None
    row = images.where(F.col("frame_id") == frame_id).select("image").first()
    return bytes(row["image"]) if row else None


def serve(spark: SparkSession, run: Search, images: DataFrame | None = None, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready for `serve_forever`."""

    class Handler(BaseHTTPRequestHandler):
        def send(self, status: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def answer(self, status: int, value: dict) -> None:
            self.send(status, json.dumps(value).encode())

        def do_GET(self) -> None:
            if self.path == "/api/health":
                return self.answer(200, {"status": "ok"})
            if self.path.startswith("/api/frames/") and images is not None and (image := frame(images, self.path.rsplit("/", 1)[1])):
                return self.send(200, image, "image/png")
            return self.answer(404, {"error": {"code": "NOT_FOUND", "message": "There is nothing here."}})

        def do_POST(self) -> None:
            if self.path != "/api/find":
                return self.answer(404, {"error": {"code": "NOT_FOUND", "message": "There is nothing here."}})
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            except ValueError:
                request = {}
            return self.answer(*find(spark, request if isinstance(request, dict) else {}, run))

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
