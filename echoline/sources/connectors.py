"""Connectors: what fetches, decodes or recognises outside of Spark.

A connector maps rows to rows and is plugged in by name; the engine works on the tables it yields. Costly ones run only
on the rows that a plan leaves them, with one instance for each task.
"""

from __future__ import annotations

import shutil
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from echoline import schemas
from echoline.tables import materialize

#: Input rows whose results are held at a time.
ROWS = 100


class Connectors:
    """Factories by role; a factory makes the row function that runs on an executor."""

    #: role: schema of what it yields
    ROLES = {
        "inspect": "media_id long, metadata string, video_url string, video_headers map<string,string>",
        "fetch_subtitle": "media_id long, source string, language string, extension string, content string, rate_limited boolean",
        "download": "media_id long, path string, length long, content_type string, error string",
        "extract_audio": "media_id long, window_start double, window_end double, path string, error string",
        "probe": "media_id long, probe string",
        "recognise_window": "media_id long, window_start double, window_end double, word_idx int, text string, start double, end double",
        "transcribe": schemas.WORDS,
        "align": f"{schemas.WORDS}, error string",
        "decode_frames": schemas.FRAMES,
        "read_text": schemas.OCR_LINES,
    }

    def __init__(self) -> None:
        self.factories: dict[str, Callable[[], Callable[[dict], list[dict]]]] = {}

    def register(self, role: str, factory: Callable[[], Callable[[dict], list[dict]]]) -> Connectors:
        if role not in self.ROLES:
            raise ValueError(f"unknown connector role: {role}")
        self.factories[role] = factory
        return self

    def run(self, role: str, rows: DataFrame, keep_going: bool = False) -> DataFrame:
        """The rows that the connector yields for each input row. keep_going, for roles that tell faults in `error`: what a row
        raises becomes its only result row, with the columns that the input has too."""
        if role not in self.factories:
            raise ValueError(f"no connector for {role}; its table has to be given instead")
        factory, schema = self.factories[role], self.ROLES[role]
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        fields = to_arrow_schema(StructType.fromDDL(schema))
        keys = {f.name for f in rows.schema if f.name in fields.names and f.dataType.typeName() in ("long", "integer", "string", "double")}
        if keep_going and "error" not in fields.names:
            raise ValueError(f"{role} can't tell faults")

        def column(found: list[dict], field: pa.Field) -> pa.Array:
            values = [r.get(field.name) for r in found]
            return pa.array([list(v.items()) if isinstance(v, dict) else v for v in values] if pa.types.is_map(field.type) else values, field.type)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one = factory()

            def attempt(row: dict) -> list[dict]:
                try:
                    return list(one(row))
                except Exception as fault:  # a connector may raise anything
                    if not keep_going:
                        raise
                    return [{k: v for k, v in row.items() if k in keys} | {"error": str(fault) or type(fault).__name__}]

            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):  # what connectors give for a row may be much
                    if found := [r for row in batch.slice(start, ROWS).to_pylist() for r in attempt(row)]:
                        yield pa.RecordBatch.from_arrays([column(found, f) for f in fields], schema=fields)

        return rows.mapInArrow(apply, schema)

    def run_refreshed(self, role: str, rows: DataFrame, refresh: str = "inspect", key: str = "media_id") -> DataFrame:
        """As run, for a connector that tells faults in `error`: rows that fail are inspected anew, once, and tried again
        with the columns that the inspection gives."""
        first = materialize(self.run(role, rows), "first-try")
        failed = rows.join(first.where("error IS NOT NULL").select(key).distinct(), key, "left_semi")
        fresh = self.run(refresh, failed)
        kept = failed.drop(*[c for c in fresh.columns if c != key])
        again = materialize(self.run(role, kept.join(fresh, key)), "second-try")
        return first.join(again.select(key).distinct(), key, "left_anti").unionByName(again)


def downloaded(connectors: Connectors, rows: DataFrame) -> DataFrame:
    """(media_id, path, length, content_type, error) of direct downloads; what is no media file, or isn't complete, is a
    fault and has no path."""
    from pyspark.sql import functions as F

    from echoline.sources import urls

    got = connectors.run("download", rows)
    kind = F.when(~urls.is_media_type(F.col("content_type")), F.concat(F.lit("not a media file: "), "content_type"))
    fault = F.coalesce("error", kind, F.when(~urls.is_complete(F.col("path"), F.col("length")), F.lit("the download is not complete")))
    return got.select("media_id", F.when(fault.isNull(), F.col("path")).alias("path"), "length", "content_type", fault.alias("error"))


def aligned(words: DataFrame, realigned: DataFrame) -> DataFrame:
    """words with the aligner's times where it gave both; `alignment_source` tells which."""
    from pyspark.sql import functions as F

    new = realigned.select("media_id", "model", "word_idx", F.col("start").alias("s"), F.col("end").alias("e"))
    rows = words.join(new, ["media_id", "model", "word_idx"], "left")
    both = F.col("s").isNotNull() & F.col("e").isNotNull()
    time = lambda new, own: F.when(both, F.col(new)).otherwise(F.col(own)).alias(own)
    return rows.select("media_id", "model", "word_idx", "text", time("s", "start"), time("e", "end"), "probability", F.when(both, "whisperx").otherwise("faster-whisper").alias("alignment_source"))


def align(words: DataFrame, connectors: Connectors) -> DataFrame:
    """words as `aligned` gives them, with `precision_fallback_reason`: why a medium's words kept their own times, if its
    aligner failed. Each medium is aligned for itself, so one that fails costs no other."""
    from pyspark.sql import functions as F

    ordered = F.array_sort(F.collect_list(F.struct("word_idx", "text", "start", "end")))
    lists = words.groupBy("media_id", "model").agg(ordered.alias("words"))
    got = materialize(connectors.run("align", lists, keep_going=True), "aligned")
    reasons = got.where("error IS NOT NULL").groupBy("media_id", "model").agg(F.min("error").alias("precision_fallback_reason"))
    return aligned(words, got.where("error IS NULL")).join(reasons, ["media_id", "model"], "left")


def timed_words(words: DataFrame) -> DataFrame:
    """Words with both times; others can't be placed."""
    return words.where("start IS NOT NULL AND end IS NOT NULL")


def missing_tools(names: tuple[str, ...] = ("ffmpeg", "ffprobe")) -> list[str]:
    return [n for n in names if shutil.which(n) is None]
