"""Results out of the engine: the flat report, its files, and published frame images."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.config import SearchConfig
from echoline.functions.text import hms
from echoline.tables import materialize


@dataclass(frozen=True)
class Provenance:
    """What made the results; constant over a run."""

    asr_model: str = "base.en"
    transcription_language: str | None = None
    alignment_source: str = "faster-whisper"
    precision_mode: str = "auto"
    ocr_model: str | None = None


#: Column of the report: (type, source column of the results, None if it comes from elsewhere).
REPORT = {
    "source_url": ("string", "source_url"), "media_path": ("string", "media_path"), "query": ("string", "query"), "matched_text": ("string", "matched_text"),
    "dialogue_start": ("double", "start"), "dialogue_end": ("double", "end"), "frame_index": ("int", "frame_index"), "frame_pts": ("bigint", "frame_pts"), "frame_time_base": ("string", "frame_time_base"),
    "frame_timestamp": ("double", "frame_timestamp"), "frame_path": ("string", "frame_path"), "match_type": ("string", "match_type"), "match_score": ("double", "score"),
    "localization_source": ("string", "localization_source"), "verification_source": ("string", "verification_source"), "caption_matched_text": ("string", "caption_text"), "caption_match_type": ("string", "caption_match_type"), "caption_match_score": ("double", "caption_score"),
    "evidence_conflict": ("boolean", "evidence_conflict"), "confidence": ("string", "confidence"), "confidence_reason": ("string", "confidence_reason"), "occurrence_count": ("int", "occurrence_count"),
    "precision_fallback_reason": ("string", "precision_fallback_reason"), "transcript_cache_hit": ("boolean", "transcript_cache_hit"), "media_metadata_cache_hit": ("boolean", "media_metadata_cache_hit"),
    "precision_fallback_used": ("boolean", "precision_fallback_used"), "precision_scope": ("string", "precision_scope"), "base_match_score": ("double", "base_score"), "precision_match_score": ("double", "precision_score"),
    "precision_fallback_eligible": ("boolean", "precision_fallback_eligible"), "precision_fallback_skip_reason": ("string", "precision_fallback_skip_reason"), "audio_processed_seconds": ("double", "audio_processed_seconds"),
}
VISIBLE = {"frame_match_type": "string", "ocr_processed_frames": "bigint", "ocr_matched_text": "string", "ocr_match_type": "string", "ocr_match_score": "double", "ocr_cache_hits": "bigint"}


def report(results: DataFrame, targets: DataFrame, config: SearchConfig | None = None, provenance: Provenance | None = None, visible: bool = False) -> DataFrame:
    """One flat row for each result, with every column of the report; what a run doesn't know is null."""
    config, provenance = config or SearchConfig(), provenance or Provenance()
    rows = results.drop("query").join(targets.select("query_id", F.col("text").alias("query")), "query_id", "left")
    known = set(rows.columns)
    column = lambda kind, name: (F.col(name) if name in known else F.lit(None)).cast(kind)
    out = [F.col("query_id"), F.col("media_id")]
    for name, (kind, source) in REPORT.items():
        value = column(kind, source)
        if name == "occurrence_count":
            value = F.greatest(F.coalesce(value, F.lit(1)), F.lit(1))
        elif name in ("evidence_conflict", "precision_fallback_used", "transcript_cache_hit", "media_metadata_cache_hit"):
            value = F.coalesce(value, F.lit(False))
        out.append(value.alias(name))
        if name in ("dialogue_start", "dialogue_end", "frame_timestamp"):
            out.append(hms(column(kind, source)).alias(f"{name}_hms"))
    out.append(hms(column("double", "audio_processed_seconds")).alias("audio_processed_hms"))
    out += [F.lit(provenance.asr_model).alias("asr_model"), F.coalesce(column("string", "asr_model_used"), F.lit(provenance.asr_model)).alias("asr_model_used")]
    out += [F.lit(v).cast("string").alias(k) for k, v in (("transcription_language", provenance.transcription_language), ("alignment_source", provenance.alignment_source), ("precision_mode", provenance.precision_mode))]
    out.append(F.lit(config.precision_trigger).alias("precision_trigger_threshold"))
    if visible:
        out += [column(kind, name).alias(name) for name, kind in VISIBLE.items()] + [F.lit(provenance.ocr_model).cast("string").alias("ocr_model")]
    return rows.select(*out)


def as_json(rows: DataFrame) -> DataFrame:
    """(query_id, media_id, json): each row as one JSON object, nulls included."""
    return rows.select("query_id", "media_id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


#: Folders of a published table; a medium's rows are all in one of them.
BUCKETS = 64


def write(rows: DataFrame, path: str, by: str = "media_id") -> None:
    """Publish rows; only what the run has anew of `by` is replaced, and readers never see half a file.

    Folders hold buckets of `by`, so that their number doesn't grow with it; a run writes those that it has rows of again, with the
    rows of others in them as they were.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(by)), F.lit(BUCKETS)).cast("int")
    new = materialize(rows, "published").withColumn("bucket", bucket)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        old = spark.read.parquet(path)
        if "bucket" not in old.columns:
            raise ValueError(f"{path} holds a table of another layout")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS rows at most
        again = new.select(F.col(by).alias("_anew")).distinct()
        kept = old.where(F.col("bucket").isin(touched)).join(again, F.col(by).eqNullSafe(F.col("_anew")), "left_anti")
        new = kept.unionByName(new, allowMissingColumns=True)
    new.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def frame_images(results: DataFrame, images: DataFrame) -> DataFrame:
    """(frame_id, media_id, frame_index, image): the chosen frames' images under opaque ids.

    images: (media_id, decode_idx, image binary). The id is a digest, so equal frames have one id in every run.
    """
    chosen = results.where("frame_index IS NOT NULL").select("media_id", F.col("frame_index").alias("decode_idx")).distinct()
    rows = images.join(chosen, ["media_id", "decode_idx"])
    return rows.select(F.substring(F.sha2(F.concat_ws("|", "media_id", "decode_idx", F.sha2("image", 256)), 256), 1, 32).alias("frame_id"), "media_id", F.col("decode_idx").alias("frame_index"), "image")


FOLDER = "frames"


def publish_images(frames: DataFrame, folder: str, ending: str = "png") -> DataFrame:
    """Write each row's image as `<folder>/frames/<media_id>-<frame_id>.<ending>` and give (frame_id, media_id, frame_index,
    path). Images of these media from earlier runs, and unfinished ones, go first; other files in the folder stay.

    An image is written under another name and then renamed, so readers never see half of one; a task that runs again
    writes the same files. folder is any that Hadoop's file systems reach, as all executors do.
    """
    spark = frames.sparkSession
    place = f"{folder.rstrip('/')}/{FOLDER}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(place)
    store = root.getFileSystem(conf)
    store.mkdirs(root)
    listed = frames.select("media_id").distinct()
    owned = rf"^(\d+)-[0-9a-f]{{32}}\.{ending}(\.part)?$"
    names = [s.getPath().getName() for s in store.listStatus(root)]
    there = spark.createDataFrame([(n,) for n in names] or [], "name string").where(F.col("name").rlike(owned))
    stale = there.withColumn("media_id", F.regexp_extract("name", owned, 1).cast("long")).join(listed, "media_id", "left_semi")
    for row in stale.toLocalIterator():
        store.delete(jvm.org.apache.hadoop.fs.Path(root, row["name"]), False)

    def write_all(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            paths = []
            for frame_id, media_id, image in zip(*(batch.column(c).to_pylist() for c in ("frame_id", "media_id", "image")), strict=True):
                system, base = fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)
                path = f"{base}/{media_id}-{frame_id}.{ending}"
                with system.open_output_stream(f"{path}.part") as out:
                    out.write(image)
                system.move(f"{path}.part", path)
                paths.append(f"{place}/{media_id}-{frame_id}.{ending}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("frame_id", "media_id", "frame_index")), pa.array(paths, pa.string())], names=["frame_id", "media_id", "frame_index", "path"])

    return materialize(frames.where("image IS NOT NULL").select("frame_id", "media_id", "frame_index", "image").mapInArrow(write_all, "frame_id string, media_id long, frame_index int, path string"), "images")
