"""Trace files: JSON lines, one file or folder a run, with an optional header line that holds no event.

Read in batch or as a stream with one explicit schema; numbers above 2**53 may come as JSON text, so
payloads stay JSON text until a typed view reads them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.trace import LINE

_FIELDS = ("seq", "t", "kind", "node", "event", "fault", "data")


def _parsed(raw: DataFrame, run: str | None) -> DataFrame:
    """Columns of LINE from raw text lines; header lines (without seq) go."""
    field = lambda name: F.get_json_object("value", f"$.{name}")
    own = F.coalesce(field("run"), F.lit(run)) if run else F.coalesce(field("run"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.jsonl", 1))
    out = raw.select(own.alias("run"), field("seq").cast("long").alias("seq"), field("t").cast("long").alias("t"), field("kind").alias("kind"), field("node").cast("int").alias("node"), field("event").alias("event"), field("fault").alias("fault"), field("data").alias("data"))
    return out.filter("seq is not null")


def read_trace(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    return _parsed(spark.read.text(path), run)


def stream_trace(spark: SparkSession, path: str, run: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    return _parsed(spark.readStream.format("text").schema("value string").option("maxFilesPerTrigger", files_per_trigger).load(path), run)


def header(spark: SparkSession, path: str) -> DataFrame:
    """The header lines' JSON text."""
    return spark.read.text(path).filter(F.get_json_object("value", "$.seq").isNull()).select(F.col("value").alias("header"))


def as_json(lines: DataFrame) -> DataFrame:
    """One JSON text a line; null fields are left out, and data stays the object that it is."""
    body = F.to_json(F.struct("run", *[c for c in _FIELDS if c != "data"]))
    return lines.select(F.when(F.col("data").isNull(), body).otherwise(F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"data":'), F.col("data"), F.lit("}"))).alias("value"))


def write_trace(lines: DataFrame, path: str, header: dict | None = None) -> None:
    """Writes trace lines, and a header line (seed, configuration, clocks, addresses) in a file of its own where one is given."""
    as_json(lines.select(*LINE.fieldNames())).write.text(path)
    if header is not None:
        if "seq" in header:
            raise ValueError("a header holds no seq: it would be read as an event")
        lines.sparkSession.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.mode("append").text(path)


def append_stream(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A streaming sink whose micro-batches are commits: the file sink's log makes each appear once."""
    return as_json(lines).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
