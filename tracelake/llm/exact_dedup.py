"""Exact deduplication by a two-pass Bloom filter.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Pass one adds
every normalised text's hash to a Bloom filter whose slots saturate at two: a slot is "twice" when
two rows touched it. A hash that occurs twice has only such slots, so pass two lets every row with
a slot touched once pass straight through and shuffles only the rest, which exact grouping decides.
A full filter only makes more rows shuffle; the result is exact at any size. The filter is broadcast, so
it has at most MAX_SLOTS slots. Where SLOTS_PER_ROW a row are more than that, the hashes are dealt to parts by
bits that no probe reads, each with a filter of its own, used and dropped before the next is made; some
0.2 % of the single rows shuffle at any size. Whole texts pass once: they are told by one filter of the
hashes found repeated, which fills up only with these.

Defined cases: null and empty texts form one group. Of equal texts the row with the largest doc_id
stays (a null doc_id only if all are null); of rows equal in text and doc_id one stays. An empty
table gives an empty result. A text of any length is hashed whole. Other columns pass through untouched,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, drop_table, fresh_name, hash_side, map_wider, own_columns, quoted, shared_checkpoint, shared_tables

SLOTS_PER_ROW = 16
MAX_PROBES = 4
#: Upper bound of the filter that is broadcast: 2**29 bits are 64 MB.
MAX_SLOTS = 1 << 29
#: A part of the hashes takes some jobs, so it isn't made for fewer rows; two bytes name the parts.
MIN_PART_ROWS = 1 << 10
MAX_PARTS = 1 << 16


class Filter(NamedTuple):
    """The bits of the slots that two or more rows touch."""

    bits: np.ndarray
    slots: int
    probes: int


def normalised_sha256(column: pa.Array) -> pa.Array:
    """SHA-256 of each text in UTF-8 with A-Z lower-cased (bytes.lower touches ASCII only)."""
    sha = hashlib.sha256
    return pa.array([sha(t.lower()).digest() for t in as_bytes(column).to_pylist()], pa.binary())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), normalised_sha256(batch.column(1))], ["id", "sha"])


def text_hashes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sha) of every row."""
    narrow = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return narrow.mapInArrow(_hashed, f"id {narrow.schema['id'].dataType.simpleString()}, sha binary")


def best_probes(rows: int, slots: int) -> int:
    """The number of probes at which the fewest single rows find all their slots touched by others."""
    return min(range(1, MAX_PROBES + 1), key=lambda k: (-math.expm1(-k * rows / slots)) ** k)


def probe_slots(sha: pa.Array, slots: int, probes: int) -> np.ndarray:
    """(rows, probes) slot numbers, taken from disjoint words of the digest."""
    raw = np.frombuffer(b"".join(sha.to_pylist()), dtype="<u8").reshape(-1, 4)[:, :probes]
    return (raw & np.uint64(slots - 1)).astype(np.int64)


def _touched(slots: int, blocks: int, probe_count: int):
    width = slots // blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            first, keys = np.unique(at // width, return_index=True)
            ends = [*keys[1:], len(at)]
            once = [(at[a:b] % width).astype("<u4").tobytes() for a, b in zip(keys, ends, strict=True)]
            twice = [(at[a:b][n[a:b] > 1] % width).astype("<u4").tobytes() for a, b in zip(keys, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["block", "once", "twice"])

        for batch in batches:
            if batch.num_rows:
                # one row touches a slot once, even where two of its probes meet
                probes = np.sort(probe_slots(batch.column(0), slots, probe_count), axis=1)
                new = np.ones(probes.shape, dtype=bool)
                new[:, 1:] = probes[:, 1:] != probes[:, :-1]
                held.append(probes[new])
            if sum(map(len, held)) > 4_000_000:
                yield from flush()
        if held:
            yield from flush()

    return run


def _merged(width: int):
    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, twice = np.zeros(width, dtype=bool), np.zeros(width, dtype=bool)
        for pdf in frames:  # a block's probes stream through; only its slots are held
            for once_b, twice_b in zip(pdf["once"], pdf["twice"], strict=True):
                at = np.frombuffer(once_b, dtype="<u4")
                twice[at[seen[at]]] = True
                seen[at] = True
                twice[np.frombuffer(twice_b, dtype="<u4")] = True
        yield pd.DataFrame({"block": [key[0]], "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    return run


def repeated_filter(hashes: DataFrame, max_slots: int = MAX_SLOTS) -> Filter:
    """Pass one: the slots that two or more rows of ``hashes`` touch."""
    rows = hashes.count()
    slots = 1 << max(7, min(max(rows * SLOTS_PER_ROW - 1, 1 << 15).bit_length(), max_slots.bit_length() - 1))  # whole bytes a block
    blocks = 1 << min(12, max(4, slots.bit_length() - 20))
    probes = best_probes(rows, slots)
    merged = hashes.select("sha").mapInArrow(_touched(slots, blocks, probes), "block int, once binary, twice binary").groupBy("block").applyInPandas(_merged(slots // blocks), "block int, bits binary")
    bits = np.zeros(slots // 8, dtype=np.uint8)
    for row in merged.toLocalIterator():  # max_slots / 8 bytes at most
        bits[row.block * (slots // blocks // 8) :][: slots // blocks // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return Filter(bits, slots, probes)


def _probed(shared, sha_at: int, name: str = "maybe"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, slots, probes = shared.value
        for batch in batches:
            at = probe_slots(batch.column(sha_at), slots, probes)
            maybe = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe, pa.bool_())], [*batch.schema.names, name])

    return run


def _repeats(hashes: DataFrame, shared) -> DataFrame:
    return hashes.mapInArrow(_probed(shared, 1), f"id {hashes.schema['id'].dataType.simpleString()}, sha binary, maybe boolean")


def filter_parts(rows: int, max_slots: int) -> int:
    """The number of parts, a power of two, of which each has SLOTS_PER_ROW slots a row."""
    wanted = min(-(-rows * SLOTS_PER_ROW // max_slots), rows // MIN_PART_ROWS, MAX_PARTS)
    return 1 << max(wanted - 1, 0).bit_length()


def marked(hashes: DataFrame, max_slots: int = MAX_SLOTS) -> DataFrame:
    """``hashes``, a table, with ``maybe``: whether the hash may occur twice."""
    context, parts = hashes.sparkSession.sparkContext, filter_parts(hashes.count(), max_slots)
    if parts == 1:
        return _repeats(hashes, context.broadcast(repeated_filter(hashes, max_slots)))
    part = F.conv(F.hex(F.substring("sha", 31, 2)), 16, 10).cast("int") % parts
    # sorted inside each file, so that reading one part skips the pages of the others
    dealt = shared_checkpoint(hashes.withColumn("part", part).sortWithinPartitions("part"))

    def one_by_one() -> Iterator[DataFrame]:
        for k in range(parts):
            own = dealt.filter(F.col("part") == k).select("id", "sha")
            shared = context.broadcast(repeated_filter(own, max_slots))
            yield _repeats(own, shared)
            shared.destroy()

    out = shared_tables(one_by_one())
    drop_table(dealt)
    return out


def routing_filter(hashes: DataFrame, max_slots: int = MAX_SLOTS) -> Filter:
    """One filter that lets no repeated hash pass: that of all ``hashes``, or of those found repeated where it takes parts."""
    if filter_parts(hashes.count(), max_slots) == 1:
        return repeated_filter(hashes, max_slots)
    repeated = shared_checkpoint(_groups(marked(hashes, max_slots).filter("maybe"))[1].filter("group_size > 1").select("sha"))
    return repeated_filter(repeated.unionByName(repeated), max_slots)  # each twice, as its rows would touch the slots


def _groups(repeats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by (sha, id), and of them by sha: both combine on the map side, so a hot text costs a row a task."""
    rows = repeats.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"))
    return rows, rows.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def dedup_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_slots: int = MAX_SLOTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    hashes = shared_checkpoint(text_hashes(df, id_col, text_col))
    probed = marked(hashes, max_slots)
    alone = probed.filter(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    rows, groups = _groups(probed.filter("maybe"))
    groups = shared_checkpoint(groups)  # a plain table beside the join, so that Spark can split a hot text's rows
    copies = rows.join(groups, "sha").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = copies.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha")
    return alone.unionByName(copies).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _with_hash(text_at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, normalised_sha256(batch.column(text_at))], [*batch.schema.names, name])

    return run


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_slots: int = MAX_SLOTS) -> DataFrame:
    """The rows of ``df`` that stay, with its columns. Rows whose hash can't repeat pass without a shuffle."""
    sha = fresh_name("sha", df.columns)
    maybe = fresh_name("maybe", [*df.columns, sha])
    hashes = shared_checkpoint(text_hashes(df, id_col, text_col))
    shared = df.sparkSession.sparkContext.broadcast(routing_filter(hashes, max_slots))
    at, df_text = len(df.columns), df.columns.index(text_col)
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _probed(shared, at, "m1")(_with_hash(df_text, "m0")(batches))

    probed = map_wider(df, both, (sha, T.BinaryType()), (maybe, T.BooleanType()))
    _, groups = _groups(_repeats(hashes, shared).filter("maybe").select("id", "sha"))
    winners = groups.select(F.col("sha").alias("w_sha"), F.col("keep_id").alias("w_id"))

    def same(a: DataFrame) -> Column:
        return (a[sha] == winners["w_sha"]) & a[quoted(id_col)].eqNullSafe(winners["w_id"])

    rest = probed.filter(F.col(maybe))
    stay = rest.join(hash_side(winners), same(rest), "left_semi").dropDuplicates([sha, id_col])
    return probed.filter(~F.col(maybe)).unionByName(stay).select(*own_columns(df))
