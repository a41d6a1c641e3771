"""SimHash near-duplicates, linked through segment popcounts.

A fingerprint's 64 bits are cut into 32 segments of two bits. The vector of their bit counts embeds
the fingerprint in a grid where Manhattan distance is a lower bound of Hamming distance. Written in
unary (0, 1, 2 as 00, 01, 11) that vector is again 64 bits wide, and Manhattan distance is the
number of differing bits of two such words. Two vectors within distance 3 agree wholly on all but three
of any groups of segments, so the range join looks up equal grid cells in the projections that leave out
three groups, filters by the Manhattan bound and verifies candidates by exact Hamming distance. Six groups
make 20 projections of some 24 bits; tables of more fingerprints take more groups, whose cells are finer.

Cells of up to SMALL_CELL fingerprints compare by a bounded window frame. Larger cells, as a hot
group of near copies makes, are cut into blocks by hash; each pair of blocks is one task of bounded memory
that compares all its pairs but returns only a spanning forest of the links it found. Connectivity,
and so every component, is the same as with all links; no pair is skipped and nothing is capped.

Defined cases: a null or empty text, or one of white space alone, has fingerprint zero, linked like
any other. Repeated rows share a fingerprint and so a component. With null doc_ids the component_id
is the smallest non-null doc_id. A long text is hashed run by run of whole words, the last two carried on.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .common import BLOCK_BYTES, fresh_name, hash_side, joined, map_wider, own_columns, pieces, quoted, shared_checkpoint, text_blocks, word_bounds
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
GROUPS = 6
MAX_GROUPS = 12
#: Bits of entropy of a segment's count: 0, 1 and 2 come with probability 1/4, 1/2 and 1/4.
SEGMENT_BITS = 1.5
SMALL_CELL = 16
BLOCK = 1024
ODD = 0x5555555555555555


def shingles(data: bytes, text_starts: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words joined by single spaces, and each shingle's start, end and text number."""
    buf = np.frombuffer(data, dtype=np.uint8)
    starts, ends = word_bounds(buf)
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    inside = np.zeros(len(buf), dtype=bool)
    edge = np.zeros(len(buf) + 1, dtype=np.int8)
    edge[starts] = 1
    edge[ends] -= 1
    np.cumsum(edge[:-1], out=edge[:-1])
    inside[:] = edge[:-1].astype(bool)
    inside[ends] = True  # one separator after each word: every text ends in a space
    plain = buf[inside].copy()
    plain[at[1:] - 1] = 0x20
    first = np.searchsorted(starts, text_starts)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][text] + offset
    last = np.minimum(begin + words, first[1:][text])
    return plain.tobytes(), at[begin], at[last] - 1, text


def word_runs(text: bytes, words: int) -> Iterator[bytes]:
    """A long text in runs of whole words that share ``words`` - 1 with the one before: together they have its shingles, each once."""
    carried: list[bytes] = []
    for piece in pieces(text):
        run = b" ".join([*carried, piece])
        carried = run.split()[1 - words :] if words > 1 else []
        yield run


def fingerprints(texts: list[bytes], words: int = SHINGLE_WORDS) -> np.ndarray:
    """SimHash of each text (UTF-8): bit k is set if set in over half of the shingles' hashes."""
    if len(texts) == 1 and len(texts[0]) > BLOCK_BYTES:
        parts = [bit_sums([run], words) for run in word_runs(texts[0], words) if len(run.split()) >= words] or [bit_sums(texts, words)]
        sums, rows = sum(p[0] for p in parts), sum(p[1] for p in parts)
    else:
        sums, rows = bit_sums(texts, words)
    return np.packbits(2 * sums > rows[:, None], axis=1, bitorder="little").view("<u8").ravel()


def bit_sums(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 64): how many shingles' hashes have each bit; and the number of each text's shingles."""
    data, starts = joined(texts)
    plain, begin, end, text = shingles(data.lower(), starts, words)
    out = np.zeros((len(texts), 64), dtype=np.int64)
    count = np.bincount(text, minlength=len(texts))
    if not len(begin):
        return out, count
    hashes = np.fromiter([xxh64_intdigest(plain[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], dtype=np.uint64, count=len(begin))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    heads = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    rows = np.diff(np.r_[heads, len(text)])
    parts = -(-rows // 255)  # sums of at most 255 rows fit a byte
    part_of = np.repeat(np.arange(len(heads)), parts)
    part_at = heads[part_of] + 255 * (np.arange(len(part_of)) - np.repeat(np.cumsum(parts) - parts, parts))
    out[text[heads]] = np.add.reduceat(np.add.reduceat(bits, part_at, axis=0).astype(np.int32), np.cumsum(parts) - parts, axis=0)
    return out, count


def fingerprint_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp: the fingerprint's 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(texts, words) for _, _, texts in text_blocks(batch.column(1))]
            fp = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    narrow = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, fp long")


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def unary_counts(fp: Column) -> Column:
    """Bit counts of the two-bit segments, each in unary: Manhattan distance is bit_count of the xor."""
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(_long(ODD))
    both = fp.bitwiseAND(high).bitwiseAND(_long(ODD))
    return some.bitwiseOR(F.shiftleft(both, 1))


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def groups_for(nodes: int, max_bits: int = MAX_BITS) -> int:
    """So many groups of segments that a projection has about as many cells as there are fingerprints, GROUPS at least.

    The links found are the same with any number."""
    bits = nodes.bit_length() - 2
    return next((g for g in range(GROUPS, MAX_GROUPS) if g > max_bits and SEGMENT_BITS * 32 * (g - max_bits) / g >= bits), MAX_GROUPS)


def grid_projections(unary: Column, max_bits: int = MAX_BITS, groups: int = GROUPS) -> Column:
    """The cell of unary_counts() in every projection of the grid, as an array."""
    group_masks = [sum(3 << (2 * k) for k in range(32) if k % groups == g) for g in range(groups)]
    masks = [sum(group_masks[g] for g in kept) for kept in combinations(range(groups), groups - max_bits)]
    return F.array(*[unary.bitwiseAND(_long(m)) for m in masks])


def grid_cells(nodes: DataFrame, max_bits: int = MAX_BITS, groups: int = GROUPS) -> DataFrame:
    """(grid, cell, fp): each fingerprint's cell in every projection of the grid."""
    embedded = nodes.select("fp", unary_counts(F.col("fp")).alias("u"))
    return embedded.select("fp", F.posexplode(grid_projections(F.col("u"), max_bits, groups)).alias("grid", "cell"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with these edges: each node with its component's smallest."""
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(names))
    i, j = index[: len(a)], index[len(a) :]
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(names)))
    return names[rest], names[label[rest]]


def _block_links(max_bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf.loc[pdf["chunk"] == pdf["i"], "fp"].to_numpy(), pdf.loc[pdf["chunk"] == pdf["j"], "fp"].to_numpy()
        a, b = [], []
        for at in range(0, len(left), 128):
            x = left[at : at + 128, None] ^ right[None, :]
            p, q = np.nonzero(np.bitwise_count(x.view(np.uint64)) <= max_bits)
            u, v = forest(left[at + p], right[q]) if len(p) else (left[:0], left[:0])
            a.append(u)
            b.append(v)
        u, v = (np.concatenate(a), np.concatenate(b)) if a else (right[:0], right[:0])
        u, v = forest(u, v) if len(u) else (u, v)
        return pd.DataFrame({"u": u, "v": v})

    return run


def shared_cells(cells: DataFrame, *by: str) -> DataFrame:
    """``cells`` with n, the rows of each cell, where that is more than one.

    Counts combine before they are shuffled. The last of ``by`` is renamed by an expression, so that Spark
    shuffles the counts anew for the join, and can then split a large cell's rows among several tasks.
    """
    counts = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return cells.join(counts.select(*by[:-1], F.col(by[-1]).bitwiseXOR(F.lit(0).cast("long")).alias(by[-1]), "n"), list(by))


def links(nodes: DataFrame, max_bits: int = MAX_BITS, small: int = SMALL_CELL, block: int = BLOCK, groups: int | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints that connect all within ``max_bits`` of each other."""
    cells = shared_checkpoint(shared_cells(grid_cells(nodes, max_bits, groups or groups_for(nodes.count(), max_bits)), "grid", "cell"))
    ordered = Window.partitionBy("grid", "cell").orderBy("fp")
    near = F.filter("next", lambda v: (differing(unary_counts(F.col("fp")), unary_counts(v)) <= max_bits) & (differing(F.col("fp"), v) <= max_bits))
    few = cells.filter(F.col("n") <= small).select("fp", F.collect_list("fp").over(ordered.rowsBetween(1, small - 1)).alias("next")).select(F.col("fp").alias("u"), F.explode(near).alias("v"))
    chunks = F.ceil(F.col("n") / block).cast("long")
    chunk = F.pmod(F.xxhash64("fp"), chunks)  # about ``block`` rows each
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("i"), F.greatest(k, F.col("chunk")).alias("j")))
    many = cells.filter(F.col("n") > small).select("grid", "cell", "fp", chunk.alias("chunk"), chunks.alias("chunks"))
    many = many.select("grid", "cell", "fp", "chunk", F.explode(pairs).alias("pair")).select("grid", "cell", "fp", "chunk", "pair.i", "pair.j")
    return few.unionByName(many.groupBy("grid", "cell", "i", "j").applyInPandas(_block_links(max_bits), "u long, v long"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id, the smallest doc_id reachable by links, and root, the smallest such fp."""
    docs = shared_checkpoint(fingerprint_rows(df, id_col, text_col, words))
    nodes = docs.groupBy("fp").agg(F.min("id").alias("least_id"))
    roots = connected_components(links(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return docs.join(placed.join(least, "root").select("fp", "component_id", "root"), "fp").select(F.col("id").alias("doc_id"), "fp", "component_id", "root")


def _with_fingerprint(df: DataFrame, text_col: str, name: str, of: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in text_blocks(batch.column(at)):
                fp = pa.array(of(texts).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in batch.columns), fp], [*batch.schema.names, "m0"])

    return map_wider(df, run, (name, T.LongType()))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stay, with its columns: one row of each component, that of the smallest doc_id.

    Rows are known by doc_id. Where several share one, they are known by fingerprint as well: of each
    component that they are in and whose smallest doc_id theirs is, one stays. Rows without doc_id stay.
    """
    return kept_rows(df, near_duplicates(df, id_col, text_col, words, max_bits), id_col, text_col, lambda texts: fingerprints(texts, words))


def kept_rows(df: DataFrame, report: DataFrame, id_col: str, text_col: str, of: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows of ``df`` that stay by its ``report`` (doc_id, fp, component_id, root), whose fingerprints are ``of`` the texts."""
    odd_id, fp, odd_fp = (fresh_name(c, df.columns) for c in ("odd_id", "fp", "odd_fp"))
    report = shared_checkpoint(report)
    lost = F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False))
    ids = report.filter("doc_id is not null").groupBy(F.col("doc_id").alias(odd_id)).agg(F.count(F.lit(1)).alias("n"), F.max(lost).alias("lost"))
    out, many = ids.filter("lost or n > 1").select(odd_id), ids.filter("n > 1").select(odd_id)
    own_id = quoted(id_col)
    plain = df.join(hash_side(out), df[own_id] == out[odd_id], "left_anti")
    shared = _with_fingerprint(df.join(hash_side(many), df[own_id] == many[odd_id], "left_semi"), text_col, fp, of)
    first = report.filter(~lost).join(many, F.col("doc_id") == many[odd_id], "left_semi").groupBy(F.col("doc_id").alias(odd_id), "root").agg(F.min("fp").alias(odd_fp))
    again = shared.join(first, (shared[own_id] == first[odd_id]) & (shared[fp] == first[odd_fp]), "left_semi").dropDuplicates([id_col, fp])
    return plain.unionByName(again.drop(fp)).select(*own_columns(df))
