"""Parts of recordings: reads only the bytes of each window, from the remote place first, from the local one where that fails.

A window is (media_id, window_start, window_end) in seconds of the recording. Readers seek in uncompressed WAV files: the
header, then the samples from the one at or before the start to the one at or after the end. How a path is opened is
plugged in (by default Arrow's file systems; an HTTP client with range requests is another), so bytes read fall with the
windows and not with the recordings. Failures are rows with `error`; only these are joined to the second reader.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.sources.connectors import Connectors
from echoline.tables import materialize

Opener = Callable[[str], BinaryIO]
SPAN = ["media_id", "window_start", "window_end"]
RANGES = "media_id long, window_start double, window_end double, first_sample long, rate int, sample_bytes int, audio binary, bytes_read long, error string"


def open_file(path: str) -> BinaryIO:
    from echoline.sources.stored import opened

    system, name = opened(path)
    return system.open_input_file(name)


class Wave:
    """Where the samples of a WAV file are, from the chunks before them."""

    def __init__(self, f: BinaryIO):
        self.f, self.bytes_read = f, 0
        head = self.take(0, 12)
        if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
            raise ValueError("not a WAV file")
        at, self.rate = 12, 0
        while True:
            chunk = self.take(at, 8)
            if len(chunk) < 8:
                raise ValueError("the WAV file has no samples")
            name, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
            at += 8
            if name == b"fmt ":
                _, _, self.rate, _, self.width, _ = struct.unpack("<HHIIHH", self.take(at, 16))
            elif name == b"data":
                break
            at += size + (size & 1)
        if not self.rate or not self.width:
            raise ValueError("the WAV file has no format")
        self.data, self.samples = at, size // self.width

    def take(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        got = self.f.read(n)
        self.bytes_read += len(got)
        return got

    def part(self, start: float, end: float) -> tuple[int, bytes]:
        first = min(self.samples, max(0, math.floor(start * self.rate)))
        last = min(self.samples, max(first, math.ceil(end * self.rate)))
        got = self.take(self.data + first * self.width, (last - first) * self.width) if last > first else b""
        if len(got) < (last - first) * self.width:
            raise ValueError("the WAV file ends early")
        return first, got


def read_ranges(windows: DataFrame, path: str, opener: Opener = open_file) -> DataFrame:
    """RANGES of windows (SPAN and a path column); a null path is a failure too. A window beyond the end has no samples."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(RANGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media_id, start, end, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found: tuple = (None, None, None, None, 0)
                try:
                    if name is None:
                        raise ValueError("no path")
                    with opener(name) as f:
                        wave = Wave(f)
                        first, audio = wave.part(start, end)
                        found, error = (first, wave.rate, wave.width, audio, wave.bytes_read), None
                except (OSError, ValueError, struct.error) as fault:
                    error = f"{type(fault).__name__}: {fault}"
                row = (media_id, start, end, *found, error)
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, fields, strict=True)], schema=fields)

    return windows.select(F.col("media_id").cast("long"), *[F.col(c).cast("double") for c in SPAN[1:]], path).mapInArrow(run, RANGES)


def seek(windows: DataFrame, remote: str, local: str, remote_opener: Opener = open_file, local_opener: Opener = open_file) -> DataFrame:
    """RANGES with `origin` (remote, local) and `remote_error` of windows (SPAN, a remote and a local path column), each distinct
    window once. The local reader sees only windows whose remote reading failed."""
    once = materialize(windows.select(*SPAN, remote, local).dropDuplicates(SPAN), "windows")
    first = materialize(read_ranges(once, remote, remote_opener), "remote-ranges")
    failed = first.where("error IS NOT NULL").select(*SPAN, F.col("error").alias("remote_error"))
    again = read_ranges(once.join(failed, SPAN, "left_semi"), local, local_opener).join(failed, SPAN)
    good = first.where("error IS NULL").withColumn("remote_error", F.lit(None).cast("string")).withColumn("origin", F.lit("remote"))
    return good.unionByName(materialize(again, "local-ranges").withColumn("origin", F.lit("local")))


def recogniser(media: DataFrame, connectors: Connectors, role: str = "recognise_window", remote: str = "remote_path", local: str = "path", remote_opener: Opener = open_file, local_opener: Opener = open_file) -> Callable[[DataFrame], DataFrame]:
    """A recogniser of windows for `verify.verify`: the connector gets each window's own samples in `audio` (remote ones if they can
    be read) and in `begins` the time of the first of them. media: (media_id, remote path, local path).

    A window that neither place has is heard as silence; `verify` adds the start of the audio stream, as for all words.
    """

    def recognise(windows: DataFrame) -> DataFrame:
        asked = windows.select(*SPAN).distinct().join(media.select("media_id", remote, local), "media_id")
        heard = connectors.run(role, seek(asked, remote, local, remote_opener, local_opener).where("error IS NULL").withColumn("begins", F.col("first_sample") / F.col("rate")))
        ordered = F.array_sort(F.collect_list(F.struct("word_idx", "text", "start", "end")))
        lists = heard.where("text IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").groupBy(*SPAN).agg(ordered.alias("w"))
        timed = F.transform("w", lambda w: F.struct(w["text"].alias("text"), w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end")))
        none = F.array().cast("array<struct<text:string,start:double,end:double>>")
        return windows.join(lists.select(*SPAN, timed.alias("words")), SPAN, "left").withColumn("words", F.coalesce("words", none))

    return recognise
