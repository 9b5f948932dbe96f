"""The whole search from media addresses: connectors are asked stage by stage, each only about what the stage before left open.

    results = connected.search_media(media, targets, connectors)

Inspection tells captions and addresses; caption variants are fetched one after another until one parses; candidates are
verified by the recordings of their windows (sought remotely, then locally); only media with an open pair are transcribed, and
aligned if an aligner is there; frames are read around the matches, as far as needed. All media and targets go through a
stage together. What a stage yields is written to the shared folder, so no connector is asked twice for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.config import SearchConfig
from echoline.operators import cache, captions, lazily, verify
from echoline.plans import search
from echoline.sources import metadata, ranges, subtitles
from echoline.sources.connectors import Connectors, align, timed_words
from echoline.tables import materialize


@dataclass
class Found:
    """results, and what was gone through for them: caption attempts (media_id, source, language, track_rank, cached, outcome) and
    words (with `alignment_source` and `precision_fallback_reason`, if they were aligned; none if no medium was transcribed)."""

    results: DataFrame
    attempts: DataFrame
    words: list[DataFrame]


def probed(media: DataFrame, connectors: Connectors, memo: str | None = None, identity: str = "") -> DataFrame:
    """(media_id, probe) of media; with memo, a folder, a medium whose row is as before is not probed again."""
    plain = [f.name for f in media.schema if f.dataType.typeName() in ("long", "integer", "string", "double", "boolean", "timestamp")]
    asked = media.withColumn("key", cache.digest(F.lit(identity), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(plain)]))

    def compute(missing: DataFrame) -> DataFrame:
        return connectors.run("probe", missing.drop("key")).join(missing.select("media_id", "key"), "media_id").select("key", F.col("probe").alias("value"))

    return cache.memoised(asked, "key", "media_info", memo, compute).select("media_id", F.col("value").alias("probe"))


def search_media(media: DataFrame, targets: DataFrame, connectors: Connectors, config: SearchConfig | None = None, stored: DataFrame | None = None, memo: str | None = None, identity: str = "") -> Found:
    """media: (media_id and what the connectors need, e.g. an address; with `remote_path` and `path` of WAV recordings windows are
    heard from their own samples). Roles: inspect, probe, fetch_subtitle, recognise_window, transcribe; align, decode_frames and
    read_text where they are registered. stored: subtitles at hand (media_id, source, language, extension, content). A medium
    without captions goes straight to speech."""
    config = config or SearchConfig()
    inspected = metadata.parsed(materialize(connectors.run("inspect", media), "inspected"), "metadata")
    spoken = inspected.select("media_id", F.coalesce("meta.language", "meta.original_language").alias("spoken"))
    tracks = metadata.caption_tracks(inspected).join(spoken, "media_id")
    tracks = materialize(captions.relevant_tracks(tracks, "spoken").drop("spoken"), "tracks")
    at_hand = F.lit(False)
    if stored is not None:
        known = stored.select("media_id", "source", "language", "extension").distinct().withColumn("at_hand", F.lit(True))
        tracks, at_hand = tracks.join(known, ["media_id", "source", "language", "extension"], "left"), F.coalesce("at_hand", F.lit(False))
    chosen, attempts = lazily.fetch_variants(tracks.withColumn("cached", at_hand).drop("at_hand"), connectors, stored)
    cues = materialize(subtitles.cues(chosen.select("media_id", "source", "language", "extension", "content")), "cues")
    about = materialize(metadata.media_info(materialize(probed(media, connectors, memo and f"{memo}/media", identity), "probed"), "probe"), "media")
    by_samples = {"remote_path", "path"} <= set(media.columns)
    clips = ranges.recogniser(media, connectors) if by_samples else verify.by_connector(connectors, memo=memo and f"{memo}/windows", identity=identity)
    said: list[DataFrame] = []

    def transcribe(some: DataFrame) -> DataFrame:
        words = timed_words(connectors.run("transcribe", media.join(some.select("media_id"), "media_id", "left_semi")))
        if "align" in connectors.factories:
            words = align(materialize(words, "heard-words"), connectors)
        said.append(materialize(words, "transcribed"))
        return said[-1].select("media_id", "model", "word_idx", "text", "start", "end", "probability")

    shots = None
    if "decode_frames" in connectors.factories:
        shots = materialize(connectors.run("decode_frames", media), "frames")
    results = materialize(search.search(cues, transcribe, targets, about, shots, config, clips=clips), "results")
    if shots is not None and "read_text" in connectors.factories:
        results = search.search_visible(results, shots, connectors, targets, config, memo and f"{memo}/texts", identity)
    return Found(results, attempts, said)
