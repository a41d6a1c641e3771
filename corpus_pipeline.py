"""A training corpus from raw documents: five stages, each one operator over all its predecessor kept.

All stages but the last return the columns of ``documents``; each is written to the shared folder
and read again, so a lost executor costs part of one stage.

Defined cases: a text that is null, empty or without a letter goes at language ID; every other text passes it.
Of equal texts the row of the largest doc_id stays (one of rows equal in text and doc_id), of near copies the
one of the smallest; rows without doc_id are never dropped as near copies. Documents without words can't come
this far. A null source is a source like any other, the last. An empty table gives an empty result at every
stage; long texts go through whole; further columns are carried on, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, exact_dedup, langid, mixing, near_copies
from tracelake.llm.common import bound_batches, shared_checkpoint

RANKS = "byte_bpe_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    bound_batches(spark)
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id: SimHash and segment popcounts name candidates,
    MinHash bands those beyond the grid's reach, and Jaccard 0.8 of five-word shingles links them."""
    return near_copies.near_dedup(docs, words=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document of the mix."""
    return bpe.encode_digest(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("language ID", language), ("exact dedup", exact), ("near-dedup", near), ("source mixing", mix), ("byte-level BPE", tokens)]

#: SQL can't express the stages; a brute-force version checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bound_batches(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_checkpoint(docs)
    return docs
