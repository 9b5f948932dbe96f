"""Live captions as a stream (an extension: the batch plans need none of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.functions.text import normalize_native


def live_phrases(cues: DataFrame, targets: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Cues of a stream (media_id, text, at timestamp) whose text holds a target of the static table, each once.

    A stream-static join on normalised text; the watermark bounds the state that drops repeats.
    """
    live = cues.withColumn("n", F.concat(F.lit(" "), normalize_native(F.col("text")), F.lit(" ")))
    asked = targets.select("query_id", F.concat(F.lit(" "), normalize_native(F.col("text")), F.lit(" ")).alias("q")).where(F.trim("q") != "")
    hits = live.join(asked, F.col("n").contains(F.col("q")))
    return hits.withWatermark("at", delay).dropDuplicatesWithinWatermark(["query_id", "media_id", "at"]).select("query_id", "media_id", "at", "text")


def live_counts(hits: DataFrame, window: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """Hits for each target and tumbling window; late cues within the delay still count."""
    return hits.withWatermark("at", delay).groupBy("query_id", F.window("at", window).alias("w")).agg(F.count(F.lit(1)).alias("hits")).select("query_id", F.col("w.start").alias("window_start"), "hits")
