"""Mixing sources to target token counts by entropy balancing.

Each source has a target of words. Among all rates w >= 0 (at most ``limit`` copies) that meet the
targets, entropy balancing takes the one closest to one copy of each document in relative entropy.
Its dual is convex with one multiplier a source, and w = min(limit, exp(multiplier x words / mean
words)): exponentially tilted rates. Newton's iterations, kept inside a bracket, solve the dual;
each is one distributed sum over the (source, words) histogram, in fixed point, so that the order
of addition can't change a result. Rates are rounded to copies by carrying the error from document
to document, largest first, inside hash chunks of bounded size; what a chunk's words still miss at the
end moves a few documents by one copy, so that a source's words come close to its target.

Defined cases: a null text has no words; documents without words are taken zero times. Sources sort
by code point, null last. Rows that share doc_id, source and size are told apart by nothing: they are
counted before they are dealt to chunks, so that however many there are, no chunk takes them all. A source
without words has target 0. A text of any length counts whole. An empty table gives an empty result. The
sources themselves (their names, sizes and multipliers) are kept on the driver: a mixture is stated by
them, and more than MAX_SOURCES are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import IS_SPACE, fresh_name, hash_side, joined, own_columns, pieces, quoted, shared_checkpoint, text_blocks

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
LIMIT = 2
CHUNK_DOCS = 4096
MAX_SOURCES = 100_000
#: Fixed point of the distributed sums; longs hold 9e15 words.
SCALE = 1024
MAX_ROUNDS = 60
TOLERANCE = 1e-7


def word_counts(texts: list[bytes]) -> np.ndarray:
    data, starts = joined(texts)
    outside = IS_SPACE[np.frombuffer(data, dtype=np.uint8)]
    first = ~outside
    first[1:] &= outside[:-1]
    return np.add.reduceat(first, starts[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [word_counts(texts) if len(texts) > 1 else np.array([sum(int(word_counts([p])[0]) for p in pieces(texts[0]))]) for _, _, texts in text_blocks(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], ["doc_id", "source", "size"])


def document_sizes(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    narrow = df.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source_col)).cast("string").alias("source"), F.col(quoted(text_col)).alias("text"))
    return narrow.mapInArrow(_counted, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, source string, size long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, limit: int = LIMIT) -> dict[str | None, Fraction]:
    """Shares of ``share`` x all words by weight; what stands above ``limit`` x a source's words is shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: Fraction(weights[k % len(weights)]) for k, s in enumerate(names)}
    full: set[str | None] = set()
    while True:
        left = share * sum(sizes.values()) - sum(Fraction(limit * sizes[s]) for s in full)
        total = sum(weight[s] for s in names if s not in full)
        out = {s: Fraction(limit * sizes[s]) if s in full else left * weight[s] / total for s in names}
        over = {s for s in names if s not in full and out[s] > limit * sizes[s]}
        if not over:
            return out
        full |= over


def _tilted(size: np.ndarray, mean: float, multiplier: float, limit: int) -> np.ndarray:
    """Rates; an infinite multiplier means ``limit`` copies of every document."""
    if math.isinf(multiplier):
        return np.full(len(size), float(limit))
    return np.minimum(float(limit), np.exp(np.minimum(multiplier * (size / mean), 50.0)))


def _sums(state: dict[str | None, tuple[float, float]], limit: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for source, own in pdf.groupby("source", dropna=False):
                source = None if pd.isna(source) else source
                mean, multiplier = state[source]
                size = own["size"].to_numpy(np.float64)
                rate, words = _tilted(size, mean, multiplier, limit), size * own["n"].to_numpy(np.float64)
                slope = np.where(rate < limit, rate * size / mean, 0.0)
                out.append((source, int(np.rint(rate * words * SCALE).astype(np.int64).sum()), int(np.rint(slope * words * SCALE).astype(np.int64).sum())))
            yield pd.DataFrame(out, columns=["source", "words", "slope"])

    return run


def multipliers(histogram: DataFrame, want: dict[str | None, Fraction], sizes: dict[str | None, int], means: dict[str | None, float], limit: int = LIMIT) -> dict[str | None, float]:
    """The dual solution by source. ``histogram``: (source, size, n)."""
    found = {s: math.inf for s in want if want[s] >= limit * sizes[s]}
    now = {s: 0.0 for s in want if s not in found}
    bracket = {s: [-math.inf, math.inf] for s in now}
    for _ in range(MAX_ROUNDS):
        if not now:
            break
        state = {s: (means[s], now.get(s, found.get(s, 0.0))) for s in want}
        totals = histogram.mapInPandas(_sums(state, limit), "source string, words long, slope long").groupBy("source").agg(F.sum("words").alias("words"), F.sum("slope").alias("slope"))
        for row in totals.collect():  # a row a source
            s = row.source
            if s not in now:
                continue
            gap = row.words / SCALE - float(want[s])
            if abs(gap) <= TOLERANCE * max(1.0, float(want[s])):
                found[s] = now.pop(s)
                continue
            low, high = bracket[s]
            low, high = (now[s], high) if gap < 0 else (low, now[s])
            bracket[s] = [low, high]
            step = now[s] - gap / (row.slope / SCALE) if row.slope else math.nan
            if not low < step < high:
                step = (low + high) / 2 if math.isfinite(low) and math.isfinite(high) else (now[s] + (1 if gap < 0 else -1) * max(1.0, abs(now[s])))
            if step == now[s]:
                found[s] = now.pop(s)
                continue
            now[s] = step
    return found | now


def _rounded(state: dict[str | None, tuple[float, float]], limit: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending")])
        table = table.take(np.repeat(np.arange(len(table)), table["n"].to_numpy()))
        mean, multiplier = state[table["source"][0].as_py()]
        size = table["size"].to_numpy()
        rate = _tilted(size.astype(np.float64), mean, multiplier, limit)
        copies, carry = np.zeros(len(size), np.int64), 0.0
        for k, (s, w) in enumerate(zip(size.tolist(), rate.tolist(), strict=True)):
            if s:
                carry += w * s
                copies[k] = n = min(max(round(carry / s), math.floor(w)), math.ceil(w), limit)
                carry -= n * s
        for k, s in enumerate(size.tolist()):  # what is still missed goes to the largest documents that make it smaller
            if s and 2 * abs(carry) > s and 0 <= copies[k] + (step := 1 if carry > 0 else -1) <= limit:
                copies[k] += step
                carry -= step * s
        return table.select(["doc_id", "source", "size"]).append_column("copies", pa.array(copies, pa.int64()))

    return run


def document_copies(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, limit: int = LIMIT) -> DataFrame:
    """``rows`` (doc_id, source, size) with source_size, target and copies."""
    histogram = shared_checkpoint(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"), F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r.source: r.words for r in per_source}
    means = {r.source: r.words / r.docs if r.docs else 1.0 for r in per_source}
    want = targets(sizes, weights, share, limit) if sizes else {}
    solved = multipliers(histogram, want, sizes, means, limit)
    state = {s: (means[s], solved[s]) for s in want}
    facts = rows.sparkSession.createDataFrame([(r.source, r.words, float(want[r.source]), -(-r.n // CHUNK_DOCS)) for r in per_source], "source string, source_size long, target double, chunks long")
    # equal rows are one row with their number, in lots of CHUNK_DOCS
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    lots = counted.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK_DOCS))))
    lots = lots.withColumn("n", F.least(F.lit(CHUNK_DOCS).cast("long"), F.col("n") - F.col("lot") * CHUNK_DOCS))
    joined_rows = lots.join(F.broadcast(facts), lots["source"].eqNullSafe(facts["source"])).select("doc_id", lots["source"], "size", "n", F.pmod(F.xxhash64("doc_id", "size", "lot"), F.col("chunks")).alias("chunk"))  # MAX_SOURCES rows at most
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, size long, copies long"
    dealt = joined_rows.groupBy("source", "chunk").applyInArrow(_rounded(state, limit), schema)
    return dealt.join(F.broadcast(facts), dealt["source"].eqNullSafe(facts["source"])).select("doc_id", dealt["source"], "size", "source_size", "target", "copies")


def mix_report(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken (words), copies of every row of ``df``."""
    rows = shared_checkpoint(document_sizes(df, id_col, source_col, text_col))
    return document_copies(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus: every row of ``df`` as often as the mix takes it, with its columns."""
    key, many, total, nth = (fresh_name(c, df.columns) for c in ("mix_id", "mix_rows", "mix_copies", "mix_nth"))
    rows = shared_checkpoint(document_sizes(df, id_col, source_col, text_col))
    taken = document_copies(rows).groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias(many), F.sum("copies").alias(total)).filter(F.col(total) > 0)
    found = df.join(hash_side(taken), df[quoted(id_col)].eqNullSafe(taken[key]))
    once = found.filter(F.col(many) == 1).withColumn(nth, F.lit(1))
    shared = found.filter(F.col(many) > 1).withColumn(nth, F.row_number().over(Window.partitionBy(quoted(id_col)).orderBy(quoted(text_col))))
    copies = F.floor((F.col(total) + F.col(many) - F.col(nth)) / F.col(many)).cast("int")
    return once.unionByName(shared).withColumn(nth, F.explode(F.array_repeat(F.lit(1), copies))).select(*own_columns(df))
