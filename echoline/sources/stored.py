"""Stored files as Spark tables: a data source over folders of media, and the sink that fills them.

A file is `<root>/<shard>/<media_id>/<name>`; the shard follows from the id, so a reader knows without listing anything
where a medium is. What a name says is known before a file is opened:

    inspect.json                      provider metadata         kind "inspect"
    <source>.<language>.<extension>   subtitles                 kind "subtitles"
    words.<model>.json                recognised words          kind "words"
    others                            downloaded media files    kind "media"

    stored.where(spark, root, "subtitles", "media_id = 7 AND language = 'en'")
    stored.read(spark, root, "subtitles")
    spark.read.format("stored").option("kind", "subtitles").load(root)  # after stored.register(spark)

A partition is a number of shards, whose files its task lists itself. `where` pushes filters on columns that names tell: shards
of other media are not planned, files that fail are not opened. Spark keeps what was pushed last with the loaded table, and all scans
of that table go by it, even those of other filters; so a plain load pushes nothing, and `where` loads a table of its own (option
`pushdown`), on which every query pushes the same. A file that can't be used is a row with `error`, never an
exception. As a stream, the source gives the files that were finished since the last batch.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from echoline.sources.subtitles import MOST_BYTES
from echoline.sources.urls import PARTIAL

SHARDS, PARTITIONS, BATCH_BYTES = 256, 64, 4 << 20
KINDS = {
    "inspect": "media_id long, metadata string, length long, error string",
    "subtitles": "media_id long, source string, language string, extension string, content string, length long, error string",
    "words": "media_id long, model string, word_idx int, text string, start double, end double, probability double, error string",
    "media": "media_id long, path string, length long, content_type string, error string",
}
#: Columns that the name of a file tells.
NAMED = {"inspect": ("media_id",), "subtitles": ("media_id", "source", "language", "extension"), "words": ("media_id", "model"), "media": ("media_id", "path")}
#: First bytes of containers that hold media.
MAGIC = {b"RIFF": "audio/wav", b"\x1aE\xdf\xa3": "video/webm", b"OggS": "audio/ogg", b"ID3": "audio/mpeg", b"fLaC": "audio/flac"}
FILTER_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def shard_of(media_id: int) -> str:
    return f"{media_id % SHARDS:03x}"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (local or one that Arrow knows by its scheme) and the path in it."""
    return fs.FileSystem.from_uri(root.rstrip("/"))


def scheme_of(root: str, top: str) -> str:
    """What a path of the file system needs in front to be a path like root."""
    root = root.rstrip("/")
    return root[: -len(top)] if root.endswith(top) else ""


def kind_of(name: str) -> str:
    parts = name.split(".")
    if name == "inspect.json":
        return "inspect"
    if len(parts) >= 3 and parts[0] == "words" and parts[-1] == "json":
        return "words"
    return "subtitles" if len(parts) == 3 and parts[0] in ("manual", "automatic") else "media"


def told(kind: str, media_id: int, name: str, path: str) -> dict[str, Any]:
    """The columns that a file's name tells."""
    parts = name.split(".")
    if kind == "subtitles":
        return {"media_id": media_id, "source": parts[0], "language": parts[1], "extension": parts[2].lower()}
    if kind == "words":
        return {"media_id": media_id, "model": ".".join(parts[1:-1])}
    return {"media_id": media_id, "path": path} if kind == "media" else {"media_id": media_id}


TESTS: dict[type, Callable[[Any, Any], bool]] = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, StringStartsWith: lambda x, v: x.startswith(v),
}


class Shards(InputPartition):
    def __init__(self, names: list[str], since: int | None = None, until: int | None = None):
        self.names, self.since, self.until = names, since, until


class Files:
    """What batch and stream reader share."""

    def __init__(self, root: str, kind: str, most: int = PARTITIONS):
        self.root, self.kind, self.most, self.filters = root, kind, most, []

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the filters that names answer and gives the others back."""
        for f in filters:
            known = len(f.attribute) == 1 and f.attribute[0] in NAMED[self.kind] if hasattr(f, "attribute") else False
            if known and isinstance(f, IsNotNull):
                continue
            if known and type(f) in TESTS and f.value is not None:
                self.filters.append((f.attribute[0], type(f), tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def shards(self) -> list[str]:
        """The shards that may hold what is asked for."""
        wanted: set[str] | None = None
        for column, test, value in self.filters:
            if column == "media_id" and test in (EqualTo, In):
                mine = {shard_of(v) for v in (value if test is In else (value,)) if v is not None}
                wanted = mine if wanted is None else wanted & mine
        return sorted(wanted) if wanted is not None else [f"{k:03x}" for k in range(SHARDS)]

    def planned(self, since: int | None = None, until: int | None = None) -> list[Shards]:
        names = self.shards()
        n = min(self.most, len(names))
        return [Shards(names[k::n], since, until) for k in range(n)]

    def listed(self, part: Shards) -> Iterator[tuple[fs.FileSystem, fs.FileInfo, dict[str, Any], str]]:
        system, root = opened(self.root)
        for shard in part.names:
            for info in sorted(system.get_file_info(fs.FileSelector(f"{root}/{shard}", allow_not_found=True, recursive=True)), key=lambda i: i.path):
                folder, _, name = info.path[len(root) + 1 :].rpartition("/")
                media = folder.rpartition("/")[2]
                if info.type != fs.FileType.File or not media.lstrip("-").isdigit() or (kind_of(name) if not unfinished(name) else "media") != self.kind:
                    continue
                if part.until is not None and not (part.since or 0) < info.mtime_ns <= part.until:
                    continue
                row = told(self.kind, int(media), name, scheme_of(self.root, root) + info.path)
                if all(TESTS[test](row[column], value) for column, test, value in self.filters):
                    yield system, info, row, name

    def rows(self, part: Shards) -> Iterator[tuple]:
        names = [c.split()[0] for c in KINDS[self.kind].split(", ")]
        for system, info, row, name in self.listed(part):
            for more in READERS[self.kind](system, info, name):
                yield tuple((row | more).get(n) for n in names)

    def batches(self, part: Shards) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in KINDS[self.kind].split(", ")])
        held, size = [], 0
        for row in self.rows(part):
            held.append(row)
            size += 64 + sum(len(v) for v in row if isinstance(v, str))
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def unfinished(name: str) -> bool:
    return name.lower().endswith(PARTIAL) or ".part-" in name.lower()


def content(system: fs.FileSystem, info: fs.FileInfo, most: int = MOST_BYTES) -> tuple[str | None, str | None]:
    """(text, error) of a file."""
    if info.size > most:
        return None, "the file is too large"
    if not info.size:
        return None, "the file is empty"
    with system.open_input_stream(info.path) as f:
        return f.read().decode("utf-8-sig", "replace"), None


def is_json(text: str) -> bool:
    """Whether a text is an object or a list; files that open with a section in brackets are not."""
    if not text.lstrip().startswith(("{", "[")):
        return False
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def inspect_rows(system: fs.FileSystem, info: fs.FileInfo, name: str) -> Iterator[dict]:
    text, error = content(system, info)
    if text is not None:
        try:
            if not isinstance(json.loads(text), dict):
                error = "the metadata is no object"
        except ValueError:
            error = "the metadata is no JSON"
    yield {"metadata": None if error else text, "length": info.size, "error": error}


def subtitle_rows(system: fs.FileSystem, info: fs.FileInfo, name: str) -> Iterator[dict]:
    text, error = content(system, info)
    if text is not None:
        head = text[:512].lstrip().lower()
        if head.startswith(("<!doctype html", "<html")):
            error = "the subtitle is a web page"
        elif not name.lower().endswith(".json3") and is_json(text):
            error = "the subtitle is an error message"
    yield {"content": None if error else text, "length": info.size, "error": error}


def word_rows(system: fs.FileSystem, info: fs.FileInfo, name: str) -> Iterator[dict]:
    """Words with both times; a file without any is one row that says so."""
    text, error = content(system, info)
    found = []
    if text is not None:
        try:
            listed = json.loads(text)
            found = [w for w in (listed.get("words") if isinstance(listed, dict) else listed) or [] if isinstance(w, dict)]
        except ValueError:
            error = "the transcription is no JSON"
    timed = [(k, w) for k, w in enumerate(found) if all(isinstance(w.get(t), int | float) for t in ("start", "end"))]
    for k, w in timed:
        likely = w.get("probability")
        yield {"word_idx": k, "text": str(w.get("text") or ""), "start": float(w["start"]), "end": float(w["end"]), "probability": float(likely) if isinstance(likely, int | float) else None}
    if not timed:
        yield {"error": error or "the transcription holds no timed words"}


def media_rows(system: fs.FileSystem, info: fs.FileInfo, name: str) -> Iterator[dict]:
    """A media file's type by its first bytes; of others nothing is read but these."""
    error, kind = None, None
    if unfinished(name) or not info.size:
        error = "the download is not complete"
    else:
        with system.open_input_stream(info.path) as f:
            head = f.read(512)
        kind = next((k for magic, k in MAGIC.items() if head.startswith(magic)), "video/mp4" if head[4:8] == b"ftyp" else "application/octet-stream")
        if head.lstrip().lower().startswith((b"<!doctype html", b"<html")):
            kind, error = "text/html", "not a media file: text/html"
    yield {"length": info.size, "content_type": kind, "error": error}


READERS = {"inspect": inspect_rows, "subtitles": subtitle_rows, "words": word_rows, "media": media_rows}


class Reader(DataSourceReader):
    def __init__(self, files: Files):
        self.files = files

    def partitions(self) -> list[Shards]:
        return self.files.planned()

    def read(self, partition: Shards) -> Iterator[pa.RecordBatch]:
        return self.files.batches(partition)


class PushingReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.files.take(filters)


class StreamReader(DataSourceStreamReader):
    """Offsets are times: a batch has the files whose last change lies in its span. A file counts as finished `settle` seconds after that."""

    def __init__(self, files: Files, settle: float):
        self.files, self.settle = files, settle

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Shards]:
        return self.files.planned(start["until"], end["until"])

    def read(self, partition: Shards) -> Iterator[tuple]:
        return self.files.rows(partition)


class StoredFiles(DataSource):
    """format("stored"): options `kind` (of KINDS), `path` (the root), `partitions` (at most), `pushdown` (see `where`) and, for streams,
    `settle` in seconds."""

    @classmethod
    def name(cls) -> str:
        return "stored"

    @property
    def files(self) -> Files:
        if self.options.get("kind") not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        return Files(self.options["path"], self.options["kind"], int(self.options.get("partitions", PARTITIONS)))

    def schema(self) -> str:
        return KINDS[self.files.kind]

    def reader(self, schema: Any) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else Reader)(self.files)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return StreamReader(self.files, float(self.options.get("settle", 10)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoredFiles)


def read(spark: SparkSession, root: str, kind: str, partitions: int = PARTITIONS) -> DataFrame:
    register(spark)
    return spark.read.format("stored").options(kind=kind, partitions=partitions).load(root)


def where(spark: SparkSession, root: str, kind: str, condition: str | Column, partitions: int = PARTITIONS) -> DataFrame:
    """The rows of a kind that satisfy a condition, of which what names tell is pushed. Filters that are put on the result are not:
    they stay above the sample, which takes every row. The session keeps pushing filters to Python sources from then on."""
    register(spark)
    spark.conf.set(FILTER_PUSHDOWN, "true")
    loaded = spark.read.format("stored").options(kind=kind, partitions=partitions, pushdown="true").load(root)
    return loaded.where(F.col("media_id").isNotNull()).where(condition).sample(1.0)


STORED = "media_id long, name string, path string, length long, error string"


def store(rows: DataFrame, root: str) -> DataFrame:
    """Writes rows (media_id, name, content) as files, each under another name first, so that no reader meets half of one, and
    gives (media_id, name, path, length, error). A repeated task writes the same files again. Runs when it is acted on."""
    schema = pa.schema([("media_id", pa.int64()), ("name", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            out = []
            for media_id, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if media_id is None or not name or "/" in name or name in (".", ".."):
                    out.append((media_id, name, None, None, "no name that can be stored"))
                    continue
                folder = f"{top}/{shard_of(media_id)}/{media_id}"
                part = f"{folder}/{name}.part-{uuid.uuid4().hex}"
                try:
                    system.create_dir(folder)
                    with system.open_output_stream(part) as f:
                        f.write(data or b"")
                    system.move(part, f"{folder}/{name}")
                    out.append((media_id, name, f"{scheme_of(root, top)}{folder}/{name}", len(data or b""), None))
                except OSError as fault:
                    out.append((media_id, name, None, None, str(fault)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.select(rows["media_id"].cast("long"), "name", rows["content"].cast("binary")).mapInArrow(run, STORED)
