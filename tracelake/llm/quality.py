"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Indicators of hashed n-grams are scaled by the classes' log-count ratios and fed to a linear hinge-
loss model, fitted by dual coordinate descent (Hsieh et al., 2008). N-grams are runs of one to three
bytes of the text, and runs of one to three word shapes: case, punctuation, length, and whether the
word, or the pair it ends, stood in the text shortly before.

The log-count ratios count every learnable labelled row. The hinge-loss model is fitted on at most
MAX_FIT_ROWS labelled rows, those with the least hash of doc_id, and of those on as many as have
MAX_FIT_FEATURES together; these bounds are the only parameters that don't grow with the data. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: a null text scores as an empty one, which has the bias alone. Rows without a label teach
nothing; contradicting labels of one doc_id count by majority, ties as 1. Without labels of both
classes every score is the share of label 1 (0.5 if none). A long text's features are those of its
runs of whole words together, with what stood before each. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLOCK_BYTES, joined, mix, pieces, quoted, run_hashes, shared_checkpoint, text_blocks, word_bounds

HASH_BITS = 18
FEATURES = 1 << HASH_BITS
MAX_FIT_ROWS = 8000
#: Features of the rows to fit, four bytes each on the driver; 8000 texts of 20 KB have some 16 million.
MAX_FIT_FEATURES = 1 << 25
#: Labels are broadcast up to this many rows of 12 bytes; beyond it the join shuffles.
BROADCAST_LABELS = 1 << 21
EPOCHS = 15
PENALTY = 1.0
SMOOTHING = 1.0
#: Slope that turns a margin into a probability.
SLOPE = 2.0
BLOCKS = 16
LOWER, UPPER, DIGIT = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"))
OTHER = ~(LOWER | UPPER | DIGIT | (np.arange(256) >= 128))


def _hashed(code: np.ndarray, kind: int) -> np.ndarray:
    return (mix(code.astype(np.uint64) << np.uint64(4) | np.uint64(kind)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _seen_before(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether the same key stood earlier in the same text."""
    order = np.lexsort((np.arange(len(key)), key, text))
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    return again


def word_looks(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A small code of each word's letters and length, and the word's hash."""

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, dtype=np.int32)
        np.cumsum(table[buf], out=sums[1:])
        return sums[ends] - sums[starts]

    length, upper, other, digit = ends - starts, share(UPPER), share(OTHER), share(DIGIT)
    case = np.where(upper == 0, 0, np.where(upper >= np.maximum(length - other - digit, 1), 2, 1))
    size = np.searchsorted(np.array([1, 3, 7, 15, 31]), length)
    last = np.where(OTHER[buf[ends - 1]], buf[ends - 1], 0).astype(np.int64)
    return (((case * 8 + size) * 4 + np.minimum(other, 3)) * 2 + (digit > 0)) << 10 | last, run_hashes(buf, starts, ends)


def word_shapes(look: np.ndarray, word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A small code of each word's look and whether it, or the pair it ends, stood in its text shortly before."""
    pair = word.copy()
    pair[1:] = mix(word[:-1] * np.uint64(3) + word[1:])
    beside = np.zeros(len(word), dtype=bool)
    beside[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    again = _seen_before(pair, text)
    return look >> 10 << 10 | (beside * 2 + again) << 8 | look & 255


def byte_features(buf: np.ndarray, text_of: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(text numbers, features) of the runs of one to three bytes."""
    found_text, found = [], []
    code = buf.astype(np.int64)
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] << 8 | buf[n - 1 :]
        own = text_of[: len(code)] == text_of[n - 1 :]
        own &= ~np.isin(np.arange(n - 1, n - 1 + len(code)), bounds[1:] - 1)  # the separator after a text isn't part of it
        found_text.append(text_of[: len(code)][own])
        found.append(_hashed(code[own], n))
    return found_text, found


def shape_features(look: np.ndarray, word: np.ndarray, word_text: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(text numbers, features) of the runs of one to three word shapes."""
    shape = word_shapes(look, word, word_text)
    run, found_text, found = shape, [], []
    for n in (1, 2, 3):
        if n > 1:
            run = run[:-1] * 1_000_003 + shape[n - 1 :]
        own = word_text[: len(run)] == word_text[n - 1 :]
        found_text.append(word_text[: len(run)][own])
        found.append(_hashed(run[own], 4 + n))
    return found_text, found


def long_features(text: bytes) -> np.ndarray:
    """The distinct features of one long text: bytes run by run, words' looks gathered and judged at the end."""
    found, looks, words, before = [], [], [], b""
    for piece in pieces(text):
        buf = np.frombuffer(before + piece, dtype=np.uint8)
        found.append(np.unique(np.concatenate(byte_features(buf, np.zeros(len(buf), np.int64), np.zeros(1, np.int64))[1])))
        own = np.frombuffer(piece, dtype=np.uint8)
        look, word = word_looks(own, *word_bounds(own))
        looks.append(look)
        words.append(word)
        before = (before + piece)[-2:]
    look, word = np.concatenate(looks), np.concatenate(words)
    if len(look):
        found += shape_features(look, word, np.zeros(len(look), np.int64))[1]
    return np.unique(np.concatenate(found))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the distinct features of each text, in that order."""
    if len(texts) == 1 and len(texts[0]) > BLOCK_BYTES:
        found = long_features(texts[0])
        return np.zeros(len(found), np.int64), found
    data, bounds = joined(texts)
    buf = np.frombuffer(data, dtype=np.uint8)
    starts, ends = word_bounds(buf)
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    found_text, found = byte_features(buf, text_of, bounds)
    if len(starts):
        more_text, more = shape_features(*word_looks(buf, starts, ends), text_of[starts])
        found_text, found = found_text + more_text, found + more
    keys = np.sort(np.concatenate(found_text) << HASH_BITS | np.concatenate(found))
    keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
    return keys >> HASH_BITS, keys & (FEATURES - 1)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, end, texts in text_blocks(batch.column(0)):
            text, feature = features(texts)
            label = labels[at:end]
            counts += np.bincount(label[text] * FEATURES + feature, minlength=2 * FEATURES).reshape(2, FEATURES)
            rows += np.bincount(label, minlength=2)
    if rows.any():
        parts = np.split(counts.astype("<i4"), BLOCKS, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([rows[0]] * BLOCKS, pa.int64()), pa.array([rows[1]] * BLOCKS, pa.int64())], ["block", "counts", "no", "yes"])


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(2 * FEATURES // BLOCKS, np.int64)
    for part in pdf["counts"]:
        total += np.frombuffer(part, "<i4")
    return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy(), "counts": [total.tobytes()], "no": [pdf["no"].sum()], "yes": [pdf["yes"].sum()]})


def log_count_ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Each feature's log-count ratio, and the rows of both classes, from all ``rows`` (text, label)."""
    parts = rows.select("text", "label").mapInArrow(_class_counts, "block int, counts binary, no long, yes long").groupBy("block").applyInPandas(_summed, "block int, counts binary, no long, yes long")
    counts, classes = np.zeros((2, FEATURES)), np.zeros(2, np.int64)
    for row in parts.collect():  # BLOCKS rows
        width = FEATURES // BLOCKS
        counts[:, row.block * width : (row.block + 1) * width] = np.frombuffer(row.counts, np.int64).reshape(2, width)
        classes[:] = row.no, row.yes
    smooth = counts + SMOOTHING
    return np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum()), classes


def _feature_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, texts in text_blocks(batch.column(0)):
            text, feature = features(texts)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, end - at), pa.array([feature[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), batch.column(2).slice(at, end - at)], ["label", "features", "place"])


def dual_coordinate_descent(samples: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss over unit-length scaled indicators."""
    weights, bias = np.zeros(len(scale)), 0.0
    alpha, random = np.zeros(len(samples)), np.random.default_rng(7)
    values = [(v := scale[s]) / max(float(np.sqrt(v @ v)), 1e-12) for s in samples]
    share = np.bincount(labels, minlength=2) / len(labels)
    top = penalty * np.where(labels == 1, 0.5 / share[1], 0.5 / share[0])
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(samples)):
            at, x, y = samples[i], values[i], 1.0 if labels[i] else -1.0
            slope = y * (float(weights[at] @ x) + bias) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), top[i])  # squared length 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                weights[at] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights * scale, bias


def fit(rows: DataFrame, docs: DataFrame, known: DataFrame, max_rows: int = MAX_FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(scale, weights, bias) from all ``rows`` (text, label), the labelled rows of ``docs`` (doc_id, text); ``known`` holds
    the labels (doc_id, label). The sample is chosen by doc_id before any text is moved."""
    ratios, classes = log_count_ratios(rows)
    if not classes.all():
        share = classes[1] / classes.sum() if classes.sum() else 0.5
        return ratios, np.zeros(FEATURES), float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))) / SLOPE
    chosen = known.orderBy(F.xxhash64(F.lit(1), F.col("doc_id")), "doc_id").limit(max_rows)
    sample = docs.join(F.broadcast(chosen), "doc_id")  # max_rows rows at most
    found = sample.select("text", "label", F.xxhash64(F.lit(1), F.col("doc_id")).alias("place")).mapInArrow(_feature_lists, "label int, features binary, place long")
    found = shared_checkpoint(found.orderBy("place", "features").limit(max_rows))  # a doc_id may have many rows
    upto = F.sum(F.octet_length("features") / 4).over(Window.orderBy("place", "features"))  # max_rows rows
    found = found.withColumn("upto", upto).filter(F.col("upto") <= MAX_FIT_FEATURES).select("label", "features").toPandas()
    found = found.sort_values(["label", "features"], ignore_index=True)  # the order of tasks doesn't matter
    labels = found["label"].to_numpy(np.int64)
    if len(np.unique(labels)) < 2:
        return ratios, np.zeros(FEATURES), float(np.log(classes[1] / classes[0])) / SLOPE
    weights, bias = dual_coordinate_descent([np.frombuffer(f, "<u4").astype(np.int64) for f in found["features"]], labels, ratios)
    return ratios, weights, bias


def scores(texts: list[bytes], scale: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    text, feature = features(texts)
    length = np.sqrt(np.bincount(text, weights=np.square(scale[feature]), minlength=len(texts)))
    margin = np.bincount(text, weights=weights[feature], minlength=len(texts)) / np.maximum(length, 1e-12) + bias
    return 1 / (1 + np.exp(-np.clip(SLOPE * margin, -500, 500)))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from; a null doc_id is learnable, but has no label."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def quality_report(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``df``."""
    rows = df.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.avg(F.when(F.col(label_col) > 0, 1.0).otherwise(0.0)) >= 0.5).cast("int").alias("label"))
    known = known.filter(~held_out(F.col("doc_id")))
    few = labels.count() <= BROADCAST_LABELS
    scale, weights, bias = fit(rows.join(F.broadcast(known) if few else known, "doc_id"), rows, known)
    shared = df.sparkSession.sparkContext.broadcast((scale, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [scores(texts, *model) for _, _, texts in text_blocks(batch.column(1))]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
