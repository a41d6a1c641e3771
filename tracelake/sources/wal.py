"""Write-ahead-log segments as binary files: a record codec, and a reader that makes rows of records.

A record is: payload length (4 bytes), CRC-32C of length and number (4), CRC-32C of those and the payload
(4), number (8), payload; integers are little-endian. A payload is one write (tag 0 put or 1 delete, the
key with its length, a put's value to the end) or a batch (tag 2, a count, and writes whose values have
lengths too). Reading a segment stops at its first torn or damaged record, which is reported as a row of
its own with ``bad`` true.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import crc32c_bytes

HEAD = struct.Struct("<IIIQ")
PUT, DELETE, BATCH = 0, 1, 2


def _checks(seq: int, payload: bytes) -> tuple[int, int]:
    named = struct.pack("<IQ", len(payload), seq)
    return crc32c_bytes(named), crc32c_bytes(named + payload)


def encode_record(seq: int, payload: bytes) -> bytes:
    return HEAD.pack(len(payload), *_checks(seq, payload), seq) + payload


def parse_records(data: bytes) -> Iterator[tuple[int | None, bytes | None, bool, int]]:
    """(seq, payload, bad, offset) of the good prefix, and one bad row where it ends early."""
    at = 0
    while at < len(data):
        if at + HEAD.size > len(data):
            yield None, None, True, at
            return
        size, head_crc, crc, seq = HEAD.unpack_from(data, at)
        payload = data[at + HEAD.size : at + HEAD.size + size]
        if len(payload) < size or _checks(seq, payload) != (head_crc, crc):
            yield None, None, True, at
            return
        yield seq, payload, False, at
        at += HEAD.size + size


def _field(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def encode_writes(writes: list[tuple[str, bytes, bytes | None]]) -> bytes:
    """The payload of a batch of (op, key, value); a batch of one is that write."""
    if len(writes) == 1:
        ((op, key, value),) = writes
        return bytes([PUT]) + _field(key) + (value or b"") if op == "put" else bytes([DELETE]) + _field(key)
    parts = [bytes([PUT]) + _field(k) + _field(v or b"") if op == "put" else bytes([DELETE]) + _field(k) for op, k, v in writes]
    return bytes([BATCH]) + struct.pack("<I", len(parts)) + b"".join(parts)


def decode_writes(data: bytes) -> list[tuple[str, bytes, bytes | None]]:
    """Undoes encode_writes(). Raises ValueError on anything else."""

    def take(at: int) -> tuple[bytes, int]:
        (size,) = struct.unpack_from("<I", data, at)
        if at + 4 + size > len(data):
            raise ValueError("a field passes the payload's end")
        return data[at + 4 : at + 4 + size], at + 4 + size

    try:
        if data[0] != BATCH:
            key, at = take(1)
            if data[0] == PUT:
                return [("put", key, data[at:])]
            if data[0] != DELETE or at != len(data):
                raise ValueError("not one write")
            return [("delete", key, None)]
        out, at = [], 5
        for _ in range(struct.unpack_from("<I", data, 1)[0]):
            tag = data[at]
            key, at = take(at + 1)
            if tag == DELETE:
                out.append(("delete", key, None))
            elif tag == PUT:
                value, at = take(at)
                out.append(("put", key, value))
            else:
                raise ValueError(f"unknown tag {tag}")
    except (IndexError, struct.error) as e:
        raise ValueError("the payload is cut short") from e
    if at != len(data):
        raise ValueError("bytes follow the last write")
    return out


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(segment, seq, bad, offset, payload) of every segment file below ``path``; the file name's digits number it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(parse_records(data))
                columns = [pa.array([segment] * len(rows), pa.int64()), *(pa.array([r[c] for r in rows], kind) for c, kind in ((0, pa.int64()), (2, pa.bool_()), (3, pa.int64()), (1, pa.binary())))]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "seq", "bad", "offset", "payload"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("segment"), "content")
    return files.mapInArrow(run, "segment long, seq long, bad boolean, offset long, payload binary")


def recovered_prefix(records: DataFrame) -> DataFrame:
    """(segment, seq, payload) of the recovered log: of several records of a number the last segment's; stops at damage
    that no later segment makes good, and at gaps."""
    from ..operators import kv

    good = records.filter("not bad").select("segment", "seq", "bad", "payload")
    return kv.wal_prefix(good, keep=("payload",))


def writes_of(records: DataFrame) -> DataFrame:
    """The write log of recovered records: a row a write, in its place of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(seq, ord_, *write) for seq, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for ord_, write in enumerate(decode_writes(payload))]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in ((3, pa.binary()), (0, pa.int64()), (1, pa.int32()), (2, pa.string()), (4, pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "seq", "ord", "op", "value"])

    return records.select("seq", "payload").mapInArrow(run, "key binary, seq long, ord int, op string, value binary")
