"""Near copies by SimHash and segment popcounts, completed by MinHash bands; exact Jaccard similarity links them.

A document's set holds the 64-bit hashes of its shingles of WORDS words, case of ASCII aside (all its
words are one shingle where it has fewer). Rows with equal sets are one node, named fp. Two nodes are
linked if their Jaccard similarity is at least SIMILARITY; no link stands on an estimate.

Candidates share a cell. First, each set's SimHash is embedded by the bit counts of its segments and looked up in the
projections of simhash's grid with its exact check (simhash.links); sets with another's SimHash within three bits share
the grid's cells, which name every such pair and many beyond. At 0.8, though, fingerprints
of 64 bits differ in some ten bits on average, more than the grid can promise. So pairs that agree in one of BANDS
bands of ROWS minima are candidates too: one at 0.8 is missed by those with probability
(1 - 0.8**5)**20 = 0.04 %, one at 0.9 with 1e-8.

Cells of up to SMALL_CELL nodes verify all their pairs. In larger ones, as a hot group of near copies
makes, every node is first verified against a few pivots; where that leaves a cell in several
components, pairs of its blocks are searched by tasks of bounded memory that return a spanning forest.
No pair that shares a cell is skipped and nothing is capped.

Defined cases: null, empty and blank texts have the empty set, one node. With null doc_ids the
component_id is the smallest non-null doc_id. A long text is hashed run by run of whole words. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLOCK_BYTES, drop_table, hash_side, joined, mix, quoted, run_hashes, shared_checkpoint, text_blocks
from .components import connected_components
from .simhash import MAX_BITS, grid_projections, groups_for, kept_rows, shingles, unary_counts, word_runs
from .simhash import links as close_fingerprints

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
SMALL_CELL = 16
BLOCK = 256
PIVOTS = 4
#: Hashes whose bits are counted at a time.
BIT_ROWS = 1 << 16
MULTIPLIERS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, one text after the other, and where each begins (plus the whole length)."""
    if len(texts) == 1 and len(texts[0]) > BLOCK_BYTES:
        parts = [_sets([run], words)[0] for run in word_runs(texts[0], words) if len(run.split()) >= words]
        if parts:
            hashes = np.unique(np.concatenate(parts))
            return hashes, np.array([0, len(hashes)])
    return _sets(texts, words)


def _sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    data, starts = joined(texts)
    plain, begin, end, text = shingles(data.lower(), starts, words)
    hashes = run_hashes(np.frombuffer(plain, dtype=np.uint8), begin, end)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])] if len(text) else np.zeros(0, bool)
    return hashes[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def set_names(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole set, zero for the empty one."""
    fp = np.zeros(len(at) - 1, dtype=np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        fp[some] = mix(np.add.reduceat(mix(hashes ^ np.uint64(0x5DEECE66D)), at[:-1][some]))
    return fp


def set_fingerprints(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of each set: bit k is set if set in over half of its (mixed) hashes; zero for the empty one."""
    size = np.diff(at)
    owner, sums = np.repeat(np.arange(len(size)), size), np.zeros((len(size), 64), dtype=np.int64)
    for first in range(0, len(hashes), BIT_ROWS):
        part = owner[first : first + BIT_ROWS]
        bits = np.unpackbits(mix(hashes[first : first + BIT_ROWS]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums[part[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def band_minima(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the minima in each band, for each set; zeros for the empty one."""
    bands = np.zeros((len(at) - 1, BANDS), dtype=np.uint64)
    some = np.flatnonzero(np.diff(at))
    for k, a in enumerate(MULTIPLIERS if len(some) else ()):
        bands[some, k // ROWS] = mix(bands[some, k // ROWS] + np.minimum.reduceat(hashes * a, at[:-1][some]))
    return bands


def signature_rows(df: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, fp, sim: the SimHash, bands: array<long>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in text_blocks(batch.column(1)):
                hashes, at = shingle_sets(texts, words)
                fp, bands = set_names(hashes, at), band_minima(hashes, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(fp.view(np.int64), pa.int64()), pa.array(set_fingerprints(hashes, at).view(np.int64), pa.int64()), lists], ["id", "fp", "sim", "bands"])

    narrow = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, fp long, sim long, bands array<long>")


def with_sets(df: DataFrame, words: int = WORDS) -> DataFrame:
    """(fp, shingles: the ascending hashes as bytes) of every row of ``df`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_blocks(batch.column(0)):
                hashes, at = shingle_sets(texts, words)
                sets = [hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_names(hashes, at).view(np.int64), pa.int64()), pa.array(sets, pa.binary())], ["fp", "shingles"])

    return df.select("text").mapInArrow(run, "fp long, shingles binary")


def _alike(common: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, similarity: float) -> np.ndarray:
    """Whether sets of sizes a and b with so many common members reach the similarity; 1e-9 is for rounding at equality."""
    return common >= similarity * (a + b - common) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v) of at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([a, b]), kind="stable")
                keep.append(bool(_alike(np.count_nonzero(both[1:] == both[:-1]), len(a), len(b), similarity)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a, b = (sets.select(F.col("fp").alias(n), F.col("shingles").alias(f"{n}_shingles")) for n in ("u", "v"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "u_shingles", "v_shingles").mapInArrow(run, "u long, v long")


def _block_links(similarity: float):
    """Searches the nodes of two blocks breadth first: each node reached is compared with all not reached yet."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("fp")
        fp, root = pdf["fp"].to_numpy(), pdf["root"].to_numpy()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in pdf["shingles"]]
        size = np.array([len(s) for s in sets])
        members, index = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        at = np.r_[0, np.cumsum(size)]
        left = np.ones(len(sets), dtype=bool)
        u, v = [], []
        while left.any():
            first = int(np.flatnonzero(left)[0])
            left[first] = False
            queue = [first]
            while queue and left.any():
                k = queue.pop()
                has = np.zeros(len(members), dtype=bool)
                has[index[at[k] : at[k + 1]]] = True
                common = np.bincount(owner[has[index]], minlength=len(sets))
                linked = left & (_alike(common, size[k], size, similarity) | (root == root[k]))
                for j in np.flatnonzero(linked):
                    u.append(fp[k])
                    v.append(fp[j])
                    queue.append(int(j))
                left &= ~linked
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return run


def links(cells: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, small: int = SMALL_CELL, block: int = BLOCK) -> DataFrame:
    """(u, v): links between the nodes of ``cells`` (of projections and bands: band, cell, fp, n) that connect all of a cell with at least that similarity."""
    order = Window.partitionBy("band", "cell").orderBy("fp")
    few = cells.filter(F.col("n") <= small).select("fp", F.collect_list("fp").over(order.rowsBetween(1, small - 1)).alias("next"))
    few = few.select(F.col("fp").alias("u"), F.explode("next").alias("v"))
    many = cells.filter(F.col("n") > small)
    pivot = F.min_by("fp", F.xxhash64("fp", F.col("band") % PIVOTS)).over(Window.partitionBy("band", "cell"))
    star = many.select(F.least("fp", pivot).alias("u"), F.greatest("fp", pivot).alias("v")).filter("u <> v")
    first = shared_checkpoint(verified(few.unionByName(star).distinct(), sets, similarity))
    if many.isEmpty():
        return first
    roots = connected_components(first).select(F.col("node").alias("fp"), "root")
    cell = Window.partitionBy("band", "cell")
    placed = many.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_cells = placed.withColumn("least", F.min("root").over(cell)).withColumn("most", F.max("root").over(cell)).filter("least <> most")
    open_cells = open_cells.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / block).cast("long")).withColumn("chunks", F.ceil(F.col("n") / block).cast("long"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("i"), F.greatest(k, F.col("chunk")).alias("j")))
    dealt = open_cells.select("band", "cell", "fp", "root", F.explode(pairs).alias("pair")).select("band", "cell", "fp", "root", "pair.i", "pair.j")
    rest = dealt.join(sets, "fp").groupBy("band", "cell", "i", "j").applyInPandas(_block_links(similarity), "u long, v long")
    return first.unionByName(rest)


def _cells(nodes: DataFrame, groups: int) -> DataFrame:
    """(band, cell, fp) of every node's bands and, if another's SimHash is within MAX_BITS of its own, of the grid."""
    sims = nodes.groupBy("sim").agg(F.count(F.lit(1)).alias("n"))
    found = close_fingerprints(sims.select(F.col("sim").alias("fp")), groups=groups).filter("u <> v")
    found = found.select(F.explode(F.array("u", "v")).alias("sim")).unionByName(sims.filter("n > 1").select("sim")).distinct()
    close = nodes.join(hash_side(found), "sim", "left_semi").withColumn("unary", unary_counts(F.col("sim")))
    grid = close.select("fp", F.posexplode(grid_projections(F.col("unary"), groups=groups)).alias("band", "cell"))
    bands = nodes.select("fp", F.posexplode("bands").alias("band", "cell")).withColumn("band", F.col("band") + comb(groups, MAX_BITS))
    return grid.unionByName(bands)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, small: int = SMALL_CELL, block: int = BLOCK, made: list[DataFrame] | None = None) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id, the smallest doc_id reachable by links, and root, the smallest such fp."""
    docs = shared_checkpoint(signature_rows(df, id_col, text_col, words))
    nodes = docs.groupBy("fp").agg(F.min("id").alias("least_id"), F.any_value("sim").alias("sim"), F.any_value("bands").alias("bands"))
    nodes = shared_checkpoint(nodes)
    cells = _cells(nodes, groups_for(nodes.count()))
    cells = shared_checkpoint(cells.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band", "cell"))).filter("n > 1"))
    wanted = cells.select("fp").distinct()
    # a node's set is made from one of its rows; rows without an id can't be looked up by it, so they all are
    by_id = docs.join(wanted, "fp", "left_semi").filter("id is not null").groupBy("fp").agg(F.min("id").alias("id"))
    texts = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    rows = texts.join(hash_side(by_id.select("id").distinct()), "id", "left_semi").unionByName(texts.filter("id is null"))
    sets = shared_checkpoint(with_sets(rows, words).join(hash_side(wanted), "fp", "left_semi").dropDuplicates(["fp"]))
    if made is not None:
        made += [nodes, cells, sets]
    roots = connected_components(links(cells, sets, similarity, small, block)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return docs.join(placed.join(least, "root").select("fp", "component_id", "root"), "fp").select(F.col("id").alias("doc_id"), "fp", "component_id", "root")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` that stay, with its columns: one row of each component, that of the smallest doc_id; shared and null doc_ids as in simhash.near_dedup."""
    made: list[DataFrame] = []
    report = shared_checkpoint(near_duplicates(df, id_col, text_col, words, similarity, made=made))
    for table in made:  # the report no longer reads them
        drop_table(table)
    return kept_rows(df, report, id_col, text_col, lambda texts: set_names(*shingle_sets(texts, words)))
