"""Costly evidence in rounds: text of frames and caption variants are asked for only while they are still needed.

Both keep a table of what is open and ask, round by round, about all open groups of the whole corpus at once. A round is
one job; what it gave is written to the shared folder, so a lost executor costs a re-read and no second request.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoline.functions.text import normalize
from echoline.operators import cache, frames
from echoline.operators.occurrences import arrow_fields, record_batch
from echoline.sources import subtitles
from echoline.sources.connectors import Connectors
from echoline.tables import materialize

PAIR = ["query_id", "media_id"]
SEEN = "query_id long, key string, matched_text string, match_type string, score double"


def image_key(identity: str):
    """The memo key of a frame's text: what reads it, and the image; frames without a digest stand for themselves."""
    own = F.concat_ws(":", F.lit("frame"), F.col("media_id").cast("string"), F.col("decode_idx").cast("string"))
    return cache.digest(F.lit(identity), F.coalesce("image_digest", own))


def read_once(images: DataFrame, connectors: Connectors, memo: str | None, identity: str, role: str = "read_text") -> DataFrame:
    """(key, text) of images (key, image_digest, media_id, decode_idx), one row for each key: from the memo, else read."""

    def compute(missing: DataFrame) -> DataFrame:
        texts = frames.frame_texts(connectors.run(role, missing.drop("key", "value")))
        rows = missing.select("key", "media_id", "decode_idx").join(texts, ["media_id", "decode_idx"], "left")
        return rows.select("key", F.coalesce("text", F.lit("")).alias("value"))  # no text is an answer too

    return cache.memoised(images, "key", f"{role}", memo, compute).select("key", F.col("value").alias("text"))


def shown(pairs: DataFrame, threshold: float) -> DataFrame:
    """SEEN for the rows (query_id, key, target, text) whose text shows the target."""
    fields = arrow_fields(pairs, SEEN)

    def run(batches):
        for batch in batches:
            rows = []
            for *ids, target, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = normalize(target or "")
                if wanted and (found := frames.visible_match(wanted, normalize(text or ""), threshold)):
                    rows.append((*ids, *found))
            if rows:
                yield record_batch(rows, fields)

    return pairs.select("query_id", "key", "target", "text").mapInArrow(run, SEEN)


def first_visible(offered: DataFrame, targets: DataFrame, connectors: Connectors, threshold: float = 85.0, memo: str | None = None, identity: str = "") -> DataFrame:
    """(query_id, media_id, decode_idx, matched_text, match_type, score, processed, asked): of the frames offered to a query
    (query_id, media_id, decode_idx, image_digest) the first, in decode order, that shows it.

    Of each pair the first frame is asked about, then the next two, four and so on while nothing was found. The text of an
    image is read once, whoever asks for it and in whatever round; with memo, a folder, also across runs. A round compares it with
    a target once, in however many media it stands.
    `processed` counts the frames up to the hit (all, if none), `asked` those of the rounds that were gone through: less than
    twice as many. Pairs whose target has nothing to look for are asked about nothing.
    """
    order = Window.partitionBy(*PAIR).orderBy("decode_idx")
    useful = targets.select("query_id", F.col("text").alias("target")).where(F.col("target").rlike(r"[\p{L}\p{N}]"))
    rows = materialize(offered.select(*PAIR, "decode_idx", "image_digest").withColumn("n", F.row_number().over(order)), "offered")
    left = rows.join(useful.select("query_id"), "query_id", "left_semi").withColumn("key", image_key(identity))
    texts: list[DataFrame] = []
    hits: list[DataFrame] = []
    gone: list[DataFrame] = []
    first, width = 1, 1
    while True:
        now = materialize(left.where((F.col("n") >= first) & (F.col("n") < first + width)), "asked-frames")
        if now.isEmpty():
            break
        images = now.groupBy("key").agg(F.min(F.struct("image_digest", "media_id", "decode_idx")).alias("i")).select("key", "i.*")
        for known in texts:
            images = images.join(known.select("key"), "key", "left_anti")
        texts.append(materialize(read_once(images, connectors, memo, identity), "frame-texts"))
        known = reduce(DataFrame.unionByName, texts)
        asked = now.select("query_id", "key").distinct().join(known, "key").join(useful, "query_id")  # an image is compared with a target once
        found = materialize(now.select(*PAIR, "decode_idx", "n", "key").join(materialize(shown(asked, threshold), "matches"), ["query_id", "key"]).drop("key"), "shown")
        hits.append(found)
        gone.append(now.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("asked")))
        first, width = first + width, 2 * width
        left = materialize(left.where(F.col("n") >= first).join(found.select(*PAIR).distinct(), PAIR, "left_anti"), "open-frames")
    totals = rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("frames"))
    if not hits:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("decode_idx", "int"), ("matched_text", "string"), ("match_type", "string"), ("score", "double"))]
        return totals.select(*PAIR, *none, F.lit(0).cast("long").alias("processed"), F.lit(0).cast("long").alias("asked"))
    best = reduce(DataFrame.unionByName, hits).groupBy(*PAIR).agg(F.min_by(F.struct("decode_idx", "matched_text", "match_type", "score", "n"), "n").alias("hit"))
    asked = reduce(DataFrame.unionByName, gone).groupBy(*PAIR).agg(F.sum("asked").alias("asked"))
    out = totals.join(asked, PAIR, "left").join(best, PAIR, "left")
    processed = F.when(F.col("asked").isNull(), F.lit(0)).otherwise(F.coalesce("hit.n", "frames"))
    return out.select(*PAIR, "hit.decode_idx", "hit.matched_text", "hit.match_type", "hit.score", processed.cast("long").alias("processed"), F.coalesce("asked", F.lit(0)).alias("asked"))


GROUP = ["media_id", "source", "language"]


def fetch_variants(tracks: DataFrame, connectors: Connectors, stored: DataFrame | None = None, role: str = "fetch_subtitle") -> tuple[DataFrame, DataFrame]:
    """(chosen variants with `content`, attempts with `outcome`): of each source and language of a medium one variant after
    another is read, stored ones first and then by rank, until one parses.

    tracks: (media_id, source, language, extension, track_rank, cached and what the connector needs). Cached variants are
    read from stored (media_id, source, language, extension, content), all others through the connector, never again
    once one of their language parses. A rate limit ends a medium's caption search: its other languages aren't asked in
    later rounds, and it has no chosen variant. A round fetches one variant of each open language of the corpus; there are as many
    rounds as the longest list that is gone through. Outcomes: parsed, unusable, missing (nothing came), rate_limited.
    """
    order = Window.partitionBy(*GROUP).orderBy(F.desc("cached"), "track_rank")
    left = materialize(tracks.withColumn("n", F.row_number().over(order)), "variants")
    names = tracks.columns
    chosen: list[DataFrame] = []
    attempts: list[DataFrame] = []
    limited: list[DataFrame] = []
    k = 1
    while True:
        now = materialize(left.where(F.col("n") == k), "asked-variants")
        if now.isEmpty():
            break
        held = now.where("cached")
        got = connectors.run(role, now.where("NOT cached").drop("n")).select(*GROUP, "content", "rate_limited")
        if stored is not None:
            own = held.select(*GROUP, "extension").join(stored.select(*GROUP, "extension", "content"), [*GROUP, "extension"])
            got = got.unionByName(own.select(*GROUP, "content", F.lit(False).alias("rate_limited")))
        got = materialize(got.groupBy(*GROUP).agg(F.max("content").alias("content"), F.max(F.coalesce("rate_limited", F.lit(False))).alias("rate_limited")), "fetched-variants")
        files = now.join(got.where("NOT rate_limited AND content IS NOT NULL").drop("rate_limited"), GROUP)
        good = files.where(subtitles.is_usable(F.col("content"), F.col("extension")))
        parsed = subtitles.cues(good.select(*GROUP, "extension", "content")).select(*GROUP).distinct().withColumn("parses", F.lit(True))
        done = now.join(got, GROUP, "left").join(parsed, GROUP, "left")
        outcome = F.when(F.col("rate_limited"), "rate_limited").when(F.col("parses"), "parsed").when(F.col("content").isNull(), "missing").otherwise("unusable")
        done = materialize(done.withColumn("outcome", outcome), "judged-variants")
        attempts.append(done.select(*GROUP, "track_rank", "cached", "outcome"))
        chosen.append(done.where("outcome = 'parsed'").select(*names, "content"))
        limited.append(done.where("outcome = 'rate_limited'").select("media_id").distinct())
        left = left.where(F.col("n") > k).join(chosen[-1].select(*GROUP), GROUP, "left_anti").join(limited[-1], "media_id", "left_anti")
        left = materialize(left, "open-variants")
        k += 1
    if not attempts:
        nothing = left.withColumn("content", F.lit(None).cast("string")).withColumn("outcome", F.lit(None).cast("string"))
        return nothing.select(*names, "content"), nothing.select(*GROUP, "track_rank", "cached", "outcome")
    stopped = reduce(DataFrame.unionByName, limited).distinct()
    return reduce(DataFrame.unionByName, chosen).join(stopped, "media_id", "left_anti"), reduce(DataFrame.unionByName, attempts)
