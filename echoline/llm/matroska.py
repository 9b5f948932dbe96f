"""Media columns: Matroska files in binary columns, parsed to packet tables.

``mux`` stores a byte payload as 8-bit PCM in a Matroska file; ``demux`` parses any such file: variable-length
EBML ids and sizes (unknown sizes too), clusters, simple and grouped blocks, the three kinds of lacing, and cues.

Defined results: a null text is an empty one; an empty payload still holds 64 zero bytes; equal texts give
equal files and features; a file that breaks off or lies about its sizes gives the packets before the fault and
a message in ``error``; files without tracks or blocks give no packets.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.base import binary_text, bound_batches, map_rows, spark_to_arrow

# Element ids of the Matroska format.
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, EBML, SEGMENT}

RATE, UNIT, FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 8000, 64, 512, 8, 8
#: Masters inside one another at most, packets in one batch of a table.
DEPTH, PACKET_ROWS = 64, 10_000
XIPH, FIXED, VARIABLE = 1, 2, 3  # of the lacing bits: Xiph 01, fixed size 10, EBML 11


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    frequency: float = 8000.0
    default_ns: int = 0


@dataclass
class Media:
    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int, int, bool]] = field(default_factory=list)  # track, ns, offset, size, cluster, lace, key
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster's offset
    scale: int = 1_000_000
    error: str = ""


def vint(value: int, width: int = 0) -> bytes:
    """value as an EBML size; all ones are kept for the unknown size."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


HEADER = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(MAX_ID_LENGTH, 4) + number(MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
TRACK = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def laced(sizes: list[int], kind: int) -> bytes:
    """The lacing header of a block whose frames have these sizes."""
    if kind == FIXED:
        return bytes([len(sizes) - 1])
    if kind == XIPH:
        return bytes([len(sizes) - 1]) + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    steps = [b - a for a, b in zip(sizes[:-2], sizes[1:-1], strict=True)]
    return bytes([len(sizes) - 1]) + vint(sizes[0]) + b"".join(signed_vint(x) for x in steps)


def signed_vint(value: int) -> bytes:
    width = next(w for w in range(1, 9) if -(1 << 7 * w - 1) < value < (1 << 7 * w - 1))
    return vint(value + (1 << 7 * width - 1) - 1, width)


def mux(payload: bytes) -> bytes:
    """A Matroska file with one 8-bit PCM track that holds payload."""
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"echoline") + element(WRITING_APP, b"echoline"))
    parts, at, cues = [info, TRACK], len(info) + len(TRACK), []
    span = FRAME * FRAMES_A_BLOCK
    for k, start in enumerate(range(0, len(payload), span * BLOCKS_A_CLUSTER)):
        base, blocks = start * 1000 // RATE, []
        for j, s in enumerate(range(start, min(len(payload), start + span * BLOCKS_A_CLUSTER), span)):
            body = payload[s : s + span]
            sizes = [FRAME] * (len(body) // FRAME) + [len(body) % FRAME] * (len(body) % FRAME > 0)
            kind = 0 if len(sizes) == 1 else (XIPH, VARIABLE, FIXED)[(j + k) % 3]
            kind = VARIABLE if kind == FIXED and sizes[-1] != sizes[0] else kind
            flag = {0: 0, XIPH: 0x02, FIXED: 0x04, VARIABLE: 0x06}[kind]
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", s * 1000 // RATE - base, 0x80 | flag) + (laced(sizes, kind) if kind else b"") + body))
        cues.append(element(CUE_POINT, number(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, number(TIMESTAMP, base) + b"".join(blocks)))
        at += len(parts[-1])
    return HEADER + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


class Broken(ValueError):
    pass


def read_vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, offset behind it, whether all value bits are ones)."""
    if at >= end or not data[at]:
        raise Broken(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Broken(f"the integer at byte {at} breaks off")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & ((1 << 7 * width) - 1)
    return raw if keep_marker else value, at + width, value == (1 << 7 * width) - 1


def demux(data: bytes) -> Media:
    """Parse a Matroska file; on a fault, what came before it and the message."""
    media = Media()
    try:
        if data[:4] != HEADER[:4]:
            raise Broken("no EBML header")
        walk(data, 0, len(data), media, {})
    except Broken as fault:
        media.error = str(fault)
    return media


def integer(data: bytes, at: int, stop: int) -> int:
    """An unsigned element that fits into a signed 64-bit column."""
    value = int.from_bytes(data[at:stop], "big")
    if value >> 63:
        raise Broken(f"the number at byte {at} is out of range")
    return value


@dataclass
class Level:
    """A master element that is being read: its id, its end, whether its size is unknown, and what its elements share."""

    ident: int
    end: int
    open: bool
    scope: dict


def walk(data: bytes, at: int, end: int, media: Media, scope: dict) -> None:
    """Parse the elements from at to end. A master of unknown size ends at the next top-level element."""
    levels = [Level(0, end, False, scope)]
    while levels:
        level = levels[-1]
        if at >= level.end:
            close(levels.pop(), media)
            continue
        began = at
        ident, at, _ = read_vint(data, at, level.end, keep_marker=True)
        while levels[-1].open and ident in TOP_LEVEL:
            close(levels.pop(), media)
        level = levels[-1]
        size, at, unknown = read_vint(data, at, level.end)
        stop = level.end if unknown else at + size
        if stop > level.end:
            raise Broken(f"the element at byte {began} is longer than what holds it")
        if ident not in MASTERS:
            if unknown:
                raise Broken(f"the element at byte {began} has no size")
            leaf(data, ident, at, stop, media, level.scope)
            at = stop
            continue
        if len(levels) > DEPTH:
            raise Broken(f"the element at byte {began} is nested too deeply")
        inner = {"segment": at if ident == SEGMENT else level.scope.get("segment", 0)}
        if ident == CLUSTER:
            media.clusters.append(began - inner["segment"])
            inner["base"] = 0
        elif ident == TRACK_ENTRY:
            inner["track"] = Track()
        elif ident == AUDIO:
            inner["track"] = level.scope.get("track")
        elif ident in (CUE_POINT, CUE_TRACK_POSITIONS):
            inner["cue"] = list(level.scope.get("cue", [0, 0, 0])) if ident == CUE_TRACK_POSITIONS else [0, 0, 0]
        elif ident == BLOCK_GROUP:
            inner |= {"base": level.scope.get("base", 0), "first": len(media.packets)}
        levels.append(Level(ident, stop, unknown and ident != SEGMENT, inner))


def close(level: Level, media: Media) -> None:
    """What is known once a master element ends."""
    if level.ident == TRACK_ENTRY:
        media.tracks[level.scope["track"].number] = level.scope["track"]
    elif level.ident == CUE_TRACK_POSITIONS:
        media.cues.append(tuple(level.scope["cue"]))
    elif level.ident == BLOCK_GROUP and level.scope.get("refers"):  # its block needs another one, so it is no key frame
        first = level.scope["first"]
        media.packets[first:] = [(*packet[:-1], False) for packet in media.packets[first:]]


def leaf(data: bytes, ident: int, at: int, stop: int, media: Media, scope: dict) -> None:
    if ident in (SIMPLE_BLOCK, BLOCK):
        block(data, at, stop, media, scope.get("base", 0), ident == SIMPLE_BLOCK)
    elif ident == REFERENCE_BLOCK:
        scope["refers"] = True
    elif ident == TIMESTAMP:
        scope["base"] = integer(data, at, stop)
    elif ident == TIMESTAMP_SCALE:
        media.scale = integer(data, at, stop)
    elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION) and "cue" in scope:
        scope["cue"][{CUE_TIME: 0, CUE_TRACK: 1, CUE_CLUSTER_POSITION: 2}[ident]] = integer(data, at, stop)
    elif (track := scope.get("track")) is not None:
        if ident == TRACK_NUMBER:
            track.number = integer(data, at, stop)
        elif ident == TRACK_TYPE:
            track.kind = integer(data, at, stop)
        elif ident == CODEC_ID:
            track.codec = data[at:stop].decode("ascii", "replace").rstrip("\0")
        elif ident == DEFAULT_DURATION:
            track.default_ns = integer(data, at, stop)
        elif ident == SAMPLING_FREQUENCY and stop - at in (4, 8):
            track.frequency = struct.unpack(">f" if stop - at == 4 else ">d", data[at:stop])[0]


def block(data: bytes, at: int, stop: int, media: Media, base: int, simple: bool) -> None:
    track, at, _ = read_vint(data, at, stop)
    if at + 3 > stop:
        raise Broken(f"the block at byte {at} breaks off")
    if track >> 31:
        raise Broken(f"the track of the block at byte {at} is out of range")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = (flags >> 1) & 3
    sizes = [stop - at]
    if kind:
        if at >= stop:
            raise Broken(f"the lacing at byte {at} breaks off")
        count, at, sizes = data[at] + 1, at + 1, []
        if kind == FIXED:
            if (stop - at) % count:
                raise Broken(f"the lacing at byte {at} is uneven")
            sizes = [(stop - at) // count] * count
        elif kind == XIPH:
            for _ in range(count - 1):
                n = 0
                while at < stop and data[at] == 255:
                    n, at = n + 255, at + 1
                if at >= stop:
                    raise Broken(f"the lacing at byte {at} breaks off")
                sizes.append(n + data[at])
                at += 1
        else:
            for k in range(count - 1):
                first = at
                n, at, _ = read_vint(data, at, stop)
                sizes.append(n if not k else sizes[-1] + n - ((1 << 7 * (at - first) - 1) - 1))
        if kind != FIXED:
            sizes.append(stop - at - sum(sizes))
        if min(sizes) < 0:
            raise Broken(f"the lacing at byte {at} is longer than its block")
    step = media.tracks[track].default_ns if track in media.tracks else 0
    start = (base + relative) * media.scale
    if not -(1 << 63) <= start <= start + len(sizes) * step < 1 << 63:
        raise Broken(f"the time of the block at byte {at} is out of range")
    for lace, n in enumerate(sizes):
        media.packets.append((track, start + lace * step, at, n, len(media.clusters) - 1, lace, bool(flags & 0x80) or not simple))
        at += n


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def feature(media: Media, payload: bytes) -> str:
    """Packet and sample statistics, equal for equal files."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    loud = samples.astype(np.float64) - 128
    spans = [b[1] - a[1] for a, b in zip(media.packets[:-1], media.packets[1:], strict=True)]
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};step_ns={max(spans, default=0)};mean={loud.mean():.4f};rms={np.sqrt((loud * loud).mean()):.4f};entropy={abs(-(p * np.log2(p)).sum()):.4f}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_clusters long, n_cues long, last_ns long"


def digest_row(doc: int | None, stored: bytes, n_bytes: int) -> tuple:
    """What the contract asks for, from the stored bytes alone."""
    media = demux(stored)
    if media.error:
        raise Broken(media.error)
    payload = b"".join(stored[at : at + n] for _, _, at, n, *_ in media.packets)
    return (doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(media, payload), len(media.packets), len(media.clusters), len(media.cues), max(x[1] for x in media.packets))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text as a Matroska file."""
    return map_rows(binary_text(df, id_col, text_col), lambda: lambda doc, text: (doc, mux(padded(text))), "id long, media binary")


PACKETS = "id long, track int, codec string, packet_idx int, timestamp_ns long, byte_offset long, byte_size long, cluster_idx int, lace_idx int, keyframe boolean, cue_time long, error string"
CUE_ROWS = "id long, cue_idx int, cue_time long, cue_ns long, track long, cluster_position long, cluster_idx int"


def packets_of(media: Media) -> Iterator[tuple]:
    """(track, codec, number, ns, offset, size, cluster, lace, key, cue time) of each packet; the cue is the last one of
    the packet's track and cluster that isn't later than the packet."""
    cues: dict[tuple[int, int], list[int]] = {}
    for time, track, at in media.cues:
        cues.setdefault((track, at), []).append(time)
    for times in cues.values():
        times.sort()
    for k, (track, ns, at, n, cluster, lace, key) in enumerate(media.packets):
        times = cues.get((track, media.clusters[cluster]), ()) if cluster >= 0 else ()
        before = bisect.bisect_right(times, ns, key=lambda t: t * media.scale)
        yield track, media.tracks[track].codec if track in media.tracks else None, k, ns, at, n, cluster, lace, key, times[before - 1] if before else None


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each packet of each file in media_col, and one with `error` for each file with a fault."""

    def rows(doc: int, media: Media) -> Iterator[tuple]:
        yield from ((doc, *packet, None) for packet in packets_of(media))
        if media.error:
            yield (doc, *[None] * 10, media.error)

    return tabled(df, id_col, media_col, rows, PACKETS)


def cue_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each cue of each file: time, track, and the cluster it points at (cluster_idx null: there is none)."""

    def rows(doc: int, media: Media) -> Iterator[tuple]:
        place = {at: k for k, at in enumerate(media.clusters)}
        for k, (time, track, at) in enumerate(media.cues):
            ns = time * media.scale
            yield doc, k, time, ns if ns < 1 << 63 else None, track, at, place.get(at)

    return tabled(df, id_col, media_col, rows, CUE_ROWS)


def tabled(df: DataFrame, id_col: str, media_col: str, rows: Callable[[int, Media], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows of each file, in batches of PACKET_ROWS at most."""
    bound_batches(df.sparkSession)
    fields = spark_to_arrow(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for doc, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for found in itertools.batched(rows(doc, demux(data or b"")), PACKET_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), fields, strict=True)], schema=fields)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, schema)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and describe both."""

    def one(doc, text):
        return digest_row(doc, mux(padded(text)), len(text or b""))

    return map_rows(binary_text(df, id_col, text_col), lambda: one, DIGEST)
