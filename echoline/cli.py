"""Command line: search Parquet tables and print results as JSON lines; failures go to stderr as JSON."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from echoline import sinks
from echoline.config import SearchConfig
from echoline.functions import rules
from echoline.operators import cache, verify
from echoline.plans import search
from echoline.session import ship


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echoline", description="Find where target lines are spoken.")
    p.add_argument("--targets", required=True, help="Parquet: query_id, text")
    p.add_argument("--words", required=True, help="Parquet: media_id, model, word_idx, text, start, end")
    p.add_argument("--media", required=True, help="Parquet: media_id, duration, audio_start_time")
    p.add_argument("--cues", help="Parquet: media_id, source, language, cue_idx, text, start, end")
    p.add_argument("--frames", help="Parquet: media_id, decode_idx, pts, timestamp")
    p.add_argument("--ocr", help="Parquet: media_id, decode_idx, line_idx, text")
    p.add_argument("--precision-words", help="Parquet of a more precise model's words")
    p.add_argument("--output", help="folder for the report; stdout if left out")
    p.add_argument("--model", default="base.en")
    p.add_argument("--language")
    p.add_argument("--threshold", type=float, default=85.0)
    p.add_argument("--margin", type=float, action="append", help="seconds around a caption; may be repeated")
    p.add_argument("--no-precision-fallback", action="store_true")
    p.add_argument("--precision-full-audio", action="store_true")
    p.add_argument("--precision-model", default=SearchConfig.precision_model)
    p.add_argument("--precision-trigger", type=float, default=SearchConfig.precision_trigger)
    p.add_argument("--cue-window", type=int, default=SearchConfig.cue_window, help="cues that a caption window has at most, unless the line is longer")
    p.add_argument("--frame-margin", type=float, default=SearchConfig.frame_margin, help="seconds around a match in which frames are read")
    p.add_argument("--ocr-model", help="name of the model that read the frames")
    p.add_argument("--images", help="Parquet: media_id, decode_idx, image; the chosen frames are published below --output")
    p.add_argument("--cache", help="folder of memo tables, handed to connectors")
    p.add_argument("--cookies", help="cookie file, handed to connectors")
    p.add_argument("--device", default="cpu", help="where connectors run their models")
    p.add_argument("--compute-type", default="int8", help="precision of the connectors' models")
    p.add_argument("--connectors", metavar="MODULE:FUNCTION", help="function of these options that gives Connectors; its recognise_window hears the windows around captions")
    return p


def clips(a: argparse.Namespace) -> verify.Recogniser | None:
    """What hears the windows around captions, if connectors are given that can."""
    if not a.connectors:
        return None
    module, _, name = a.connectors.partition(":")
    made = getattr(importlib.import_module(module), name)(a)
    if "recognise_window" not in made.factories:
        return None
    who = cache.identity(a.model, {}, a.compute_type, a.language, a.device)
    return verify.by_connector(made, memo=f"{a.cache.rstrip('/')}/windows" if a.cache else None, identity=who)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        config = SearchConfig(caption_threshold=a.threshold, verification_threshold=a.threshold, visible_threshold=a.threshold, cue_window=a.cue_window, frame_margin=a.frame_margin, precision_model=a.precision_model, precision_trigger=min(a.precision_trigger, a.threshold), margins=tuple(a.margin or (2.0, 5.0)), precision_fallback=not a.no_precision_fallback, precision_full_audio=a.precision_full_audio)
        spark = spark or SparkSession.builder.appName("echoline").getOrCreate()
        ship(spark)
        read = lambda path: spark.read.parquet(path) if path else None
        targets, words, media, frames = read(a.targets), read(a.words), read(a.media), read(a.frames)
        if a.cues:
            results = search.search(read(a.cues), words, targets, media, frames, config, read(a.precision_words), clips(a))
        else:
            results = search.search_speech(words, targets, media, frames, a.threshold)
        if a.ocr and frames is not None and "confidence" in results.columns:
            results = search.search_visible(results, frames, read(a.ocr), targets, config)
        rows = sinks.report(results, targets, config, sinks.Provenance(asr_model=a.model, transcription_language=a.language, ocr_model=a.ocr_model), visible=bool(a.ocr))
        if a.output:
            sinks.write(rows, a.output)
            if a.images:
                sinks.publish_images(sinks.frame_images(results, read(a.images)), a.output.rstrip("/") + "-images")
        else:
            for r in sinks.as_json(rows).orderBy("query_id", "media_id").toLocalIterator():
                print(r["json"])
    except Exception as fault:
        message = str(fault).splitlines()[0] if str(fault) else type(fault).__name__
        found = {"error": message, "error_code": "processing_failed", "error_stage": "pipeline"}
        if spark is not None:
            row = spark.range(1).select(rules.error_stage(F.lit(message)).alias("e")).first()["e"]
            found |= {"error_code": row["code"], "error_stage": row["stage"]}
        print(json.dumps(found), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
