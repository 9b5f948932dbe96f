"""TTML as cues: a state machine over tags, which takes what is there of files that are no proper XML.

Times are clock times (with a fraction, or with frames of the file's own rate), or offsets in hours, minutes, seconds,
milliseconds, frames or ticks. They count from the begin of the enclosing element, or in a sequence from the end of the element
before; an element ends with the enclosing one at the latest. What has no end at all has no length and is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

CLOCK = re.compile(r"(?:(\d+):)?(\d+):(\d+)(?:[.,](\d+)|:(\d+)(?:\.(\d+))?)?$")
OFFSET = re.compile(r"(\d+(?:\.\d+)?)\s*(h|ms|m|s|f|t)$")
CUES = "media_id long, source string, language string, text string, start double, end double"


class Rates:
    """What frames and ticks last, from the attributes of the root."""

    def __init__(self, attributes: dict[str, str]):
        number = lambda name, default: float(v) if re.fullmatch(r"\d+(\.\d+)?", v := attributes.get(name, "")) and float(v) else default
        over, under = ([float(x) for x in re.findall(r"\d+", attributes.get("framerate-multiplier", attributes.get("frameratemultiplier", "")))] + [1.0, 1.0])[:2]
        self.parts = number("subframerate", 1.0)
        self.frames = number("framerate", 30.0) * over / under if over and under else number("framerate", 30.0)
        self.ticks = number("tickrate", self.frames * self.parts if "framerate" in attributes else 1.0)

    def seconds(self, time: str | None) -> float | None:
        time = (time or "").strip().lower()
        if m := CLOCK.match(time):
            hours, minutes, whole, fraction, frames, parts = m.groups()
            out = int(hours or 0) * 3600 + int(minutes) * 60 + int(whole) + (float(f"0.{fraction}") if fraction else 0.0)
            return out + (int(frames) + int(parts or 0) / self.parts) / self.frames if frames else out
        if m := OFFSET.match(time):
            unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001, "f": 1 / self.frames, "t": 1 / self.ticks}[m[2]]
            return float(m[1]) * unit
        return None


class Element:
    def __init__(self, name: str, begin: float, end: float | None, sequence: bool):
        self.name, self.begin, self.end, self.sequence, self.next = name, begin, end, sequence, begin


class TimedText(HTMLParser):
    """cues: (text, start, end) of each paragraph, in the file's order."""

    def __init__(self, content: str):
        super().__init__(convert_charrefs=True)
        self.cues: list[tuple[str, float, float | None]] = []
        self.rates, self.open, self.text = Rates({}), [Element("", 0.0, None, False)], None
        self.feed(content)
        self.close()
        while len(self.open) > 1:  # what a file that breaks off has begun
            self.leave()

    @staticmethod
    def plain(name: str) -> str:
        return name.rpartition(":")[2]

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        name, given = self.plain(tag), {self.plain(k): v or "" for k, v in attributes}
        if name == "tt":
            self.rates = Rates(given)
        if name == "br":
            self.handle_data(" ")
            return
        if name == "p" and self.open[-1].name == "p":  # paragraphs don't nest: the one before was not closed
            self.leave()
        above = self.open[-1]
        origin = above.next if above.sequence else above.begin
        begin, end, lasts = (self.rates.seconds(given.get(k)) for k in ("begin", "end", "dur"))
        start = origin + (begin or 0.0)
        ends = [t for t in (above.end, None if end is None else origin + end, None if lasts is None else start + lasts) if t is not None]
        self.open.append(Element(name, start, min(ends) if ends else None, given.get("timecontainer") == "seq"))
        if name == "p":
            self.text = []

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)
        if self.plain(tag) != "br":
            self.leave()

    def handle_endtag(self, tag: str) -> None:
        name = self.plain(tag)
        if any(e.name == name for e in self.open[1:]):
            while self.leave() != name:
                pass

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)

    def leave(self) -> str:
        done = self.open.pop()
        if done.name == "p" and self.text is not None:
            self.cues.append((" ".join("".join(self.text).split()), done.begin, done.end))
            self.text = None
        if done.end is not None:
            self.open[-1].next = max(self.open[-1].next, done.end)
        return done.name


def cues(files: DataFrame) -> DataFrame:
    """CUES of rows (media_id, source, language, content)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(CUES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*key, text, round(start, 3), None if end is None else round(end, 3)) for *key, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for text, start, end in TimedText((content or b"").decode("utf-8-sig", "replace")).cues]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return files.select(files["media_id"].cast("long"), "source", "language", files["content"].cast("binary")).mapInArrow(run, CUES)
