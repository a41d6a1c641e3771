"""A sink that writes write-ahead-log segments, as a Python data source of Spark: each task writes its records in segment files.

A segment is named by its first number, so names sort as records do. Tasks write to names of their own,
and the driver's commit renames them: a task that runs again, or a write that fails, leaves no segment.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .wal import encode_record, encode_writes

SEGMENT_BYTES = 64 << 20


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: (name while writing, final name)."""

    files: list[tuple[str, str]]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


class SegmentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, segment_bytes: int) -> None:
        self.path, self.segment_bytes = path, segment_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        files: list[tuple[str, str]] = []
        out, size = None, 0
        for batch in batches:
            for seq, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = encode_record(seq, payload)
                if out is None or size >= self.segment_bytes:
                    if out is not None:
                        out.close()
                    files.append((posixpath.join(root, f".writing-{uuid.uuid4().hex}"), posixpath.join(root, f"{seq:020d}.wal")))
                    out, size = store.open_output_stream(files[-1][0]), 0
                out.write(record)
                size += len(record)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _place(self.path)
        for message in messages:
            for temporary, final in message.files if message else []:
                store.move(temporary, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _place(self.path)
        for message in messages:
            for temporary, _ in message.files if message else []:
                store.delete_file(temporary)


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wal_segments"

    def writer(self, schema, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(self.options["path"], int(self.options.get("segment_bytes", SEGMENT_BYTES)))


def records_of(log: DataFrame) -> DataFrame:
    """(seq, payload): the record of each batch of a write log (key, seq, ord, op, value; keys and values binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [encode_writes([(w["op"], w["key"], w["value"]) for w in writes]) for writes in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(payloads, pa.binary())], ["seq", "payload"])

    write = F.struct("ord", F.col("op"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    grouped = log.groupBy("seq").agg(F.array_sort(F.collect_list(write)).alias("writes"))  # one batch
    return grouped.mapInArrow(run, "seq long, payload binary")


def write_segments(log: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes a write log as segment files that read_segments() reads, in order of number; tasks take ranges of numbers."""
    spark: SparkSession = log.sparkSession
    spark.dataSource.register(SegmentSource)
    ordered = records_of(log).repartitionByRange("seq").sortWithinPartitions("seq")
    ordered.write.format("wal_segments").option("path", path).option("segment_bytes", segment_bytes).mode("append").save()
