"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile ranks the PROFILE_SIZE most frequent byte n-grams (one to three bytes of lower-cased words,
a space before and after each word). A document's own profile is compared with each language's by
the out-of-place distance: the sum of rank differences, PROFILE_SIZE for an n-gram that is missing.
Profiles are counted over every learnable row; each document is ranked over its whole text.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if
nothing can be learned. Ties go to the smaller n-gram, and between languages to the first by name.
Rows whose language is null teach nothing. A long text is counted run by run of whole words and ranked
over all of them. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh_name, own_columns, pieces, quoted, text_blocks

PROFILE_SIZE = 300
UNDETERMINED = "und"
#: An n-gram's code: its length above bit 24, its bytes below.
CODE_BITS = 26
COUNT_BITS = 20
LETTERS = np.zeros(256, dtype=bool)
LETTERS[ord("a") : ord("z") + 1] = True
LETTERS[128:] = True


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, code) of every n-gram of the texts."""
    lowered = b" ".join([b"", *(t.decode("utf-8", "replace").lower().replace("\0", " ").encode() + b"\0" for t in texts), b""])
    buf = np.frombuffer(lowered, dtype=np.uint8)
    letter, end = LETTERS[buf], buf == 0
    text = np.cumsum(end, dtype=np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one separator after each word
    keep[0] = True
    codes = np.where(letter, buf, 0x20)[keep].astype(np.int64)
    text = text[keep]
    gap = codes == 0x20
    one, two = ~gap, ~(gap[:-1] & gap[1:])
    three = ~gap[1:-1]
    pair = codes[:-1] << 8 | codes[1:]
    triple = pair[:-1] << 8 | codes[2:]
    # a separator before a word may stand in the text before: the word's own byte tells the text
    owner = np.where(gap[:-1], text[1:], text[:-1])
    return np.concatenate([text[one], owner[two], text[1:-1][three]]), np.concatenate([codes[one] | 1 << 24, pair[two] | 2 << 24, triple[three] | 3 << 24])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)])


def counted_ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (text number above CODE_BITS, code) of the texts' n-grams in order, and how often each occurs."""
    if len(texts) != 1:
        text, code = ngrams(texts)
        return counted(text << CODE_BITS | code)
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for piece in pieces(texts[0]):  # n-grams don't cross white space
        own, m = counted(ngrams([piece])[1])
        keys, where = np.unique(np.r_[keys, own], return_inverse=True)
        n = np.bincount(where, weights=np.r_[n, m], minlength=len(keys)).astype(np.int64)
    return keys, n


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for at, end, texts in text_blocks(batch.column(1)):
            names, number = np.unique(langs[at:end].astype(str), return_inverse=True)
            keys, n = counted_ngrams(texts)
            keys, where = np.unique(number[keys >> CODE_BITS] << CODE_BITS | keys & ((1 << CODE_BITS) - 1), return_inverse=True)
            n = np.bincount(where, weights=n, minlength=len(keys)).astype(np.int64)
            for k, name in enumerate(names):
                own = keys >> CODE_BITS == k
                have = totals.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                codes, where = np.unique(np.r_[have[0], keys[own] & ((1 << CODE_BITS) - 1)], return_inverse=True)
                totals[name] = codes, np.bincount(where, weights=np.r_[have[1], n[own]], minlength=len(codes)).astype(np.int64)
    for name, (codes, n) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])


def learn_profiles(rows: DataFrame) -> pd.DataFrame:
    """(lang, code, rank) of the languages' profiles, from ``rows`` (lang, text)."""
    counts = rows.filter("lang is not null and text is not null").select(F.col("lang").cast("string"), "text").mapInArrow(_language_counts, "lang string, code long, n long")
    totals = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")))
    return ranked.filter(F.col("rank") <= PROFILE_SIZE).select("lang", "code", (F.col("rank") - 1).alias("rank")).toPandas()  # PROFILE_SIZE rows a language


class Profiles:
    """Language profiles as a table of ranks by n-gram."""

    def __init__(self, learned: pd.DataFrame) -> None:
        self.langs = sorted(learned["lang"].unique())
        self.codes = np.sort(learned["code"].unique().astype(np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, dtype=np.int32)
        lang = np.searchsorted(np.array(self.langs, dtype=object), learned["lang"].to_numpy(dtype=object)) if len(learned) else []
        self.ranks[lang, np.searchsorted(self.codes, learned["code"].to_numpy(np.int64))] = learned["rank"].to_numpy(np.int32)

    def distances(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): out-of-place distance over what it is if no n-gram is known."""
        keys, n = counted_ngrams(texts)
        mask = (1 << CODE_BITS) - 1
        if n.max(initial=0) < 1 << COUNT_BITS:
            rarity = (1 << COUNT_BITS) - 1 - n
            order = np.sort(keys >> CODE_BITS << CODE_BITS + COUNT_BITS | rarity << CODE_BITS | keys & mask)
            text, code = order >> CODE_BITS + COUNT_BITS, order & mask
        else:  # counts of a text of many MB don't fit the key
            keys = keys[np.lexsort((keys & mask, -n, keys >> CODE_BITS))]
            text, code = keys >> CODE_BITS, keys & mask
        heads = np.searchsorted(text, np.arange(len(texts) + 1))
        rank = np.arange(len(code)) - heads[:-1][text]
        top = rank < PROFILE_SIZE
        text, code, rank = text[top], code[top], rank[top]
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        out = np.ones((len(texts), len(self.langs)))
        most = np.maximum(np.bincount(text, minlength=len(texts)), 1) * PROFILE_SIZE
        for k in range(len(self.langs)):
            place = self.ranks[k, at]
            cost = np.where(known & (place >= 0), np.abs(place - rank), PROFILE_SIZE)
            out[:, k] = np.bincount(text, weights=cost, minlength=len(texts)) / most
        return out


def _predicted(shared, text_at: int, rest: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for batch in batches:
            for at, end, texts in text_blocks(batch.column(text_at)):
                own = batch.slice(at, end - at)
                letters = own.column(0).to_numpy(zero_copy_only=False).astype(bool)
                if profiles.langs:
                    far = profiles.distances(texts)
                    near = np.sort(far, axis=1)[:, :2]
                    first, second = near[:, 0], near[:, 1] if near.shape[1] > 1 else np.ones(len(texts))
                    best = far.argmin(axis=1)
                    score = np.where(first + second > 0, second / np.maximum(first + second, 1e-12), 0.5)
                else:
                    letters, best, score = np.zeros(len(texts), bool), np.zeros(len(texts), np.int64), np.zeros(len(texts))
                lang = [profiles.langs[k] if some else UNDETERMINED for k, some in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns[rest:], pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())], names)

    return run


def identify(df: DataFrame, profiles: pd.DataFrame, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default), then the prediction and its score as ``names``, which must be free.

    A kept text is sent to Python once.
    """
    keep = df.columns if keep is None else keep
    if clash := {c.lower() for c in keep} & {c.lower() for c in names}:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    shared = df.sparkSession.sparkContext.broadcast(Profiles(profiles))
    text = F.col(quoted(text_col))
    own = [F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"), *([] if text_col in keep else [text.alias("_text")])]
    wide = df.select(*own, *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(keep)])
    text_at = len(own) + keep.index(text_col) if text_col in keep else 1
    schema = T.StructType([*wide.schema.fields[len(own) :], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    out = wide.mapInArrow(_predicted(shared, text_at, len(own), schema.names), schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], F.col("lang_pred").alias(names[0]), F.col("lang_score").alias(names[1]))


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learned from; a null doc_id is learnable."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def language_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learned from the rows that aren't held out."""
    rows = df.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang"), held_out(F.col(quoted(id_col))).alias("held_out"))
    profiles = learn_profiles(rows.filter("not held_out").select("lang", "text"))
    return identify(rows, profiles, keep=["doc_id", "held_out"]).withColumnRenamed("lang_score", "score").select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` with a determined language, with its columns; rows without a letter go."""
    rows = df.select(F.col(quoted(lang_col)).alias("lang"), F.col(quoted(text_col)).alias("text"), held_out(F.col(quoted(id_col))).alias("held_out"))
    profiles = learn_profiles(rows.filter("not held_out").select("lang", "text"))
    names = fresh_name("lang_pred", df.columns), fresh_name("lang_score", df.columns)
    return identify(df, profiles, text_col, names=names).filter(F.col(names[0]) != UNDETERMINED).select(*own_columns(df))
