"""Matroska media columns: bytes stored as 8-bit PCM packets, and a parser that makes packet tables.

``parse`` walks EBML elements of variable length (known and unknown sizes), clusters, simple blocks
and block groups, Xiph, EBML and fixed lacing, tracks and cues, and gives every packet's track,
timestamp and byte range. ``mux`` writes a payload as one audio track of 8-bit samples.

Defined cases: a null text is empty; the payload is padded with zero bytes to a positive multiple
of 64, so an empty text stores 64 zero bytes. Null or damaged media have no packets from the damage
on, and ``complete`` false; damaged are also numbers of impossible width and times beyond 64 bits. A text
of any length is stored whole. Equal texts give equal bytes. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, quoted, text_blocks

# Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
CHAPTERS, TAGS, ATTACHMENTS = 0x1043A770, 0x1254C367, 0x1941A469
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: What ends a cluster or segment of unknown size.
SEGMENT_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}

PAD = 64
RATE = 8000
FRAME = 4096
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 4


class Damaged(ValueError):
    """The bytes end, or contradict themselves, inside an element."""


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int | None, int]:
    """(value, next position); an id keeps its length marker; None is the unknown size."""
    if at >= len(data) or not data[at]:
        raise Damaged(f"no variable-length integer at {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data) or (keep_marker and length > 4):
        raise Damaged(f"integer at {at} is too long")
    value = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return value, at + length
    value &= (1 << 7 * length) - 1
    return (None if value == (1 << 7 * length) - 1 else value), at + length


@dataclass
class Media:
    """Tracks, packets (track, timestamp ns, offset, size, keyframe, lace, cluster) and cues of a file."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    laced: int = 0
    complete: bool = True


def _uint(data: bytes, a: int, b: int) -> int:
    if b - a > 8:
        raise Damaged(f"integer at {a} has {b - a} bytes")
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise Damaged(f"float at {a} has {b - a} bytes")
    return 0.0 if a == b else struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]


def _time(ns: int) -> int:
    if not -(1 << 63) <= ns < 1 << 63:
        raise Damaged("a time passes 64 bits")
    return ns


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Frame sizes of a laced block and where its first frame starts. kind: 1 Xiph, 2 fixed, 3 EBML."""
    if at >= end:
        raise Damaged(f"no lace head at {at}")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        each, over = divmod(end - at, count)
        if over:
            raise Damaged(f"fixed lacing at {at} doesn't divide")
        return [each] * count, at
    for k in range(count - 1):
        if kind == 1:
            size = 0
            while True:
                if at >= end:
                    raise Damaged(f"Xiph lacing at {at} doesn't end")
                step, at = data[at], at + 1
                size += step
                if step < 255:
                    break
        else:
            start = at
            value, at = read_vint(data, at, False)
            if value is None:
                raise Damaged(f"EBML lacing at {start} has an unknown size")
            size = value if not k else sizes[-1] + value - ((1 << (7 * (at - start) - 1)) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged(f"lacing at {at} passes its block")
    return sizes, at


def _block(data: bytes, a: int, b: int, media: Media, base: int, key: bool | None) -> None:
    track, at = read_vint(data, a, False)
    if track is None or at + 3 > b:
        raise Damaged(f"block at {a} is short")
    when = (base + int.from_bytes(data[at : at + 2], "big", signed=True)) * media.scale
    flags, at = data[at + 2], at + 3
    kind = flags >> 1 & 3
    sizes, at = lace_sizes(data, at, b, kind) if kind else ([b - at], at)
    media.laced += bool(kind)
    each = media.tracks.get(track, {}).get("default_duration", 0)
    for k, size in enumerate(sizes):
        media.packets.append((track, _time(when + k * each), at, size, bool(flags & 0x80) if key is None else key, k, media.clusters - 1))
        at += size


def _children(data: bytes, at: int, end: int | None, limit: int, stop: set[int]):
    """(id, start, end of content) of a master element's children; returns where they end.

    ``end`` None: the master's size is unknown, and an id in ``stop`` ends it."""
    known = end is not None
    end = limit if end is None else end
    while at < end:
        name, body = read_vint(data, at, True)
        if not known and name in stop:
            break
        size, body = read_vint(data, body, False)
        if size is None or body + size > end:
            raise Damaged(f"element {name:X} at {at} has no good size")
        yield name, body, body + size
        at = body + size
    return at


def _cluster(data: bytes, at: int, end: int | None, limit: int, media: Media) -> int:
    media.clusters += 1
    base, walk = 0, _children(data, at, end, limit, SEGMENT_LEVEL | {EBML, SEGMENT})
    while True:
        try:
            name, a, b = next(walk)
        except StopIteration as done:
            return done.value
        if name == TIMESTAMP:
            base = _uint(data, a, b)
        elif name == SIMPLE_BLOCK:
            _block(data, a, b, media, base, None)
        elif name == BLOCK_GROUP:
            inner = list(_children(data, a, b, b, set()))
            key = not any(n == REFERENCE_BLOCK for n, _, _ in inner)
            for n, x, y in inner:
                if n == BLOCK:
                    _block(data, x, y, media, base, key)


def _track(data: bytes, a: int, b: int) -> tuple[int, dict]:
    out: dict = {"type": 0, "codec": "", "default_duration": 0, "rate": 8000.0, "channels": 1, "bits": 0}
    number = 0
    for name, x, y in _children(data, a, b, b, set()):
        if name == TRACK_NUMBER:
            number = _uint(data, x, y)
        elif name == TRACK_TYPE:
            out["type"] = _uint(data, x, y)
        elif name == CODEC_ID:
            out["codec"] = data[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif name == DEFAULT_DURATION:
            out["default_duration"] = _uint(data, x, y)
        elif name == AUDIO:
            for n, p, q in _children(data, x, y, y, set()):
                if n == SAMPLING_FREQUENCY:
                    out["rate"] = _float(data, p, q)
                elif n == CHANNELS:
                    out["channels"] = _uint(data, p, q)
                elif n == BIT_DEPTH:
                    out["bits"] = _uint(data, p, q)
    return number, out


def _cue(data: bytes, a: int, b: int, scale: int, start: int) -> Iterator[tuple[int, int, int]]:
    when = 0
    for name, x, y in _children(data, a, b, b, set()):
        if name == CUE_TIME:
            when = _uint(data, x, y)
        elif name == CUE_TRACK_POSITIONS:
            inner = {n: _uint(data, p, q) for n, p, q in _children(data, x, y, y, set())}
            yield _time(when * scale), inner.get(CUE_TRACK, 0), start + inner.get(CUE_CLUSTER_POSITION, 0)


def _segment(data: bytes, at: int, end: int, media: Media) -> int:
    start = at
    while at < end:
        name, body = read_vint(data, at, True)
        if name in (EBML, SEGMENT):
            return at
        size, body = read_vint(data, body, False)
        stop = None if size is None else body + size
        if stop is not None and stop > end:
            if name == CLUSTER:
                _cluster(data, body, end, end, media)
            raise Damaged(f"element {name:X} at {at} passes its parent's end")
        if name == CLUSTER:
            at = _cluster(data, body, stop, end, media)
            continue
        if stop is None:
            raise Damaged(f"element {name:X} at {at} has no size")
        if name == INFO:
            for n, x, y in _children(data, body, stop, stop, set()):
                if n == TIMESTAMP_SCALE:
                    media.scale = _uint(data, x, y)
                elif n == DURATION:
                    media.duration = _float(data, x, y)
        elif name == TRACKS:
            media.tracks.update(_track(data, x, y) for n, x, y in _children(data, body, stop, stop, set()) if n == TRACK_ENTRY)
        elif name == CUES:
            for n, x, y in _children(data, body, stop, stop, set()):
                if n == CUE_POINT:
                    media.cues.extend(_cue(data, x, y, media.scale, start))
        at = stop
    return at


def parse(data: bytes) -> Media:
    """Everything readable in the file; ``complete`` is false where damage ended the reading."""
    media, at = Media(), 0
    try:
        while at < len(data):
            name, body = read_vint(data, at, True)
            size, body = read_vint(data, body, False)
            end = len(data) if size is None else body + size
            if name == SEGMENT:
                at = _segment(data, body, min(end, len(data)), media)
            elif name == EBML:
                for n, x, y in _children(data, body, end, end, set()):
                    if n == DOC_TYPE:
                        media.doc_type = data[x:y].decode("ascii", "replace")
                at = end
            else:
                at = end
            if end > len(data):
                raise Damaged("the file is cut short")
    except Damaged:
        media.complete = False
    return media


def vint(value: int) -> bytes:
    """The shortest size field; all ones are the unknown size, so they take a byte more."""
    length = 1
    while value >= (1 << 7 * length) - 1:
        length += 1
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint_element(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def ebml_lace(sizes: list[int]) -> bytes:
    """The first size, then signed differences, of all sizes but the last."""
    out = vint(sizes[0])
    for before, now in zip(sizes, sizes[1:-1], strict=False):
        step, length = now - before, 1
        while not -((1 << 7 * length - 1) - 1) <= step <= (1 << 7 * length - 1) - 1:
            length += 1
        out += ((step + (1 << 7 * length - 1) - 1) | 1 << 7 * length).to_bytes(length, "big")
    return out


def block_body(track: int, relative: int, frames: list[bytes]) -> bytes:
    """A key block: one frame as it is, equal sizes in fixed lacing, others in EBML lacing."""
    sizes = [len(f) for f in frames]
    kind = 0 if len(frames) == 1 else 2 if len(set(sizes)) == 1 else 3
    head = vint(track) + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1])
    if kind:
        head += bytes([len(frames) - 1])
    return head + (ebml_lace(sizes) if kind == 3 else b"") + b"".join(frames)


HEADER = element(EBML, uint_element(EBML_VERSION, 1) + uint_element(EBML_READ_VERSION, 1) + uint_element(EBML_MAX_ID, 4) + uint_element(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint_element(DOC_TYPE_VERSION, 4) + uint_element(DOC_TYPE_READ_VERSION, 2))
TRACK = element(TRACKS, element(TRACK_ENTRY, uint_element(TRACK_NUMBER, 1) + uint_element(TRACK_UID, 1) + uint_element(TRACK_TYPE, 2) + uint_element(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint_element(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint_element(CHANNELS, 1) + uint_element(BIT_DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples: laced blocks of frames, a cue for every cluster."""
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    info = element(INFO, uint_element(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"tracelake") + element(WRITING_APP, b"tracelake"))
    parts, cues, at = [info, TRACK], [], len(info) + len(TRACK)
    span = FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for first in range(0, len(frames), span):
        base = first * FRAME * 1000 // RATE
        body = uint_element(TIMESTAMP, base)
        for k in range(first, min(first + span, len(frames)), FRAMES_A_BLOCK):
            body += element(SIMPLE_BLOCK, block_body(1, k * FRAME * 1000 // RATE - base, frames[k : min(k + FRAMES_A_BLOCK, first + span)]))
        cues.append(element(CUE_POINT, uint_element(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, uint_element(CUE_TRACK, 1) + uint_element(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, body))
        at += len(parts[-1])
    return HEADER + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % PAD or (0 if text else PAD))


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """The bytes of a track's packets, in file order."""
    return b"".join(data[a : a + n] for t, _, a, n, _, _, _ in media.packets if t == track)


def features(payload: bytes, media: Media) -> str:
    """Packet counts, and statistics of the samples, as key=value pairs."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    high = samples >= 128
    energy = float(np.square(samples.astype(np.float32) - 128).mean(dtype=np.float64)) if len(samples) else 0.0
    times = [p[1] for p in media.packets]
    return ";".join((f"packets={len(media.packets)}", f"laced={media.laced}", f"clusters={media.clusters}", f"cues={len(media.cues)}", f"last_ms={max(times, default=0) // 1_000_000}", f"duration_ms={media.duration:.0f}", f"mean={samples.mean() if len(samples) else 0:.4f}", f"rms={energy**0.5:.4f}", f"crossings={int(np.count_nonzero(high[1:] != high[:-1]))}", f"complete={int(media.complete)}"))


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, padded, as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in text_blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    narrow = df.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


PACKETS = "track long, timestamp_ns long, byte_offset long, byte_size long, keyframe boolean, lace int, cluster int"


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of every file: doc_id, packet number, track, timestamp, byte range, keyframe, lace, cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, files in text_blocks(batch.column(1)):
                found = [parse(x).packets for x in files]
                rows = [(k, *p) for packets in found for k, p in enumerate(packets)]
                ids = batch.column(0).slice(at, end - at).take(pa.array(np.repeat(np.arange(len(files)), [len(p) for p in found])))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "packet", "track", "timestamp_ns", "byte_offset", "byte_size", "keyframe", "lace", "cluster"])

    narrow = df.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(media_col)).alias("media"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, packet long, {PACKETS}")


def media_features(media: DataFrame) -> DataFrame:
    """Digests of what is read back from ``media`` (doc_id, n_bytes, media), and its features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column(2)).to_pylist():
                found = parse(data)
                payload = payload_of(data, found)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, found)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds))], names)

    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
