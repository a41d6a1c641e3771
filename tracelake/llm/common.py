"""Helpers shared by the corpus operators: shared checkpoints, names, byte blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once by the numpy kernels, whose temporaries are some 50 times as large.
BLOCK_BYTES = 1 << 18
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary one on a single machine (tests); on a cluster it raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


#: Bytes of a row group of an intermediate table: a task that writes one holds so much.
ROW_GROUP_BYTES = 32 << 20


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read from there from now on.

    Cuts the lineage and survives lost executors. The table goes when the application ends, or with drop_table.
    """
    return shared_tables([df])


def shared_tables(frames: Iterable[DataFrame]) -> DataFrame:
    """The rows of ``frames``, which have one schema and are at least one, as such a table: each is written before the next is asked for."""
    path = None
    for df in frames:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
        df.write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    out._table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Removes the table behind a frame that shared_checkpoint returned, once nothing reads it any more."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._table_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh_name(stem: str, taken: list[str]) -> str:
    """A column name that clashes with none of ``taken``, whatever the case of their letters."""
    lower = {c.lower() for c in taken}
    while stem.lower() in lower:
        stem += "_"
    return stem


def hash_side(side: DataFrame) -> DataFrame:
    """A join's side of keys and numbers, to be hashed per partition: the other side, of whole texts, then isn't sorted."""
    return side.hint("shuffle_hash")


def quoted(name: str) -> str:
    """A column's name as one identifier, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def map_wider(df: DataFrame, run, *more: tuple[str, T.DataType]) -> DataFrame:
    """``df.mapInArrow(run)`` where ``run`` adds the columns ``more``; the columns of ``df`` may have any names."""
    plain = df.select(*[c.alias(f"c{k}") for k, c in enumerate(own_columns(df))])
    added = [T.StructField(f"m{k}", kind) for k, (_, kind) in enumerate(more)]
    made = plain.mapInArrow(run, T.StructType([*plain.schema.fields, *added]))
    return made.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(df.columns)], *[F.col(f"m{k}").alias(name) for k, (name, _) in enumerate(more)])


#: Rows of an Arrow batch: at Spark's 10,000, texts of 100 KB make batches of 1 GB.
BATCH_ROWS = 256


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, unless they are smaller: whole texts go through them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_bytes(column: pa.Array) -> pa.Array:
    """A text or binary column as large_binary, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, texts) for runs of rows of at most ``limit`` bytes together, one row at least."""
    binary = as_bytes(column)
    ends = np.frombuffer(binary.buffers()[1], dtype=np.int64, count=len(binary) + 1 + binary.offset)[binary.offset :] if len(binary) else np.zeros(1, np.int64)
    at = 0
    while at < len(binary):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, end, binary.slice(at, end - at).to_pylist()
        at = end


_space = re.compile(rb"[\x09-\x0d\x20]")


def pieces(text: bytes, limit: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A long text in runs of whole words of about ``limit`` bytes, so that what kernels need beside a text is bounded.

    Cuts fall after white space; a run is longer only where one word is.
    """
    at = 0
    while len(text) - at > limit:
        cut = _space.search(text, at + limit - 1)
        if cut is None or cut.end() == len(text):
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def byte_table(members: tuple[int, ...] | bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


IS_SPACE = byte_table(SPACES)


def word_bounds(buf: np.ndarray, outside: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes not marked in ``outside``."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~outside[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts with one space after each, and where each starts (plus the whole length)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return b" ".join(texts) + b" ", starts


#: Odd multiplier of the polynomial hash of byte runs modulo 2**64, and its inverse.
POLY = 0x9E3779B97F4A7C15
POLY_INVERSE = pow(POLY, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << max(n - 1, 1).bit_length(), BLOCK_BYTES * 2)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= BLOCK_BYTES * 4:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, by prefix sums of a polynomial."""
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(POLY, len(buf)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(POLY_INVERSE, len(buf) + 1)[starts] + (ends - starts).astype(np.uint64))
