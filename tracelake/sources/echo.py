"""Journals of an echo server: files of 16-byte records, a number and its FNV-1a hash, both little-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import fnv1a64_bytes

RECORD = struct.Struct("<QQ")


def encode(number: int) -> bytes:
    return RECORD.pack(number, fnv1a64_bytes(struct.pack("<Q", number)))


def replay(data: bytes) -> tuple[int, int, bool]:
    """(valid, corrupt, torn): records whose hash fits, those whose hash doesn't, and whether a part of one ends the file."""
    whole = len(data) // RECORD.size * RECORD.size
    valid = sum(fnv1a64_bytes(struct.pack("<Q", number)) == said for number, said in RECORD.iter_unpack(data[:whole]))
    return valid, whole // RECORD.size - valid, whole < len(data)


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """(path, valid, corrupt, torn) of every journal file below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [replay(data) for data in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.bool_())))], ["path", "valid", "corrupt", "torn"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, valid long, corrupt long, torn boolean")
