"""A small SQL subset over versioned tables: INSERT, UPDATE and DELETE append versions; reads pick the newest.

A versioned table is a write log whose value is a struct of columns (operators.kv reads it). UPDATE and
DELETE read one snapshot and append a batch at the next version, so a reader of an older one sees the old rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kv


def create(rows: DataFrame, key: str) -> DataFrame:
    """A versioned table holding ``rows`` at version 1."""
    values = F.struct(*[c for c in rows.columns if c != key])
    return rows.select(F.col(key).alias("key"), F.lit(1).cast("long").alias("seq"), F.lit(0).alias("ord"), F.lit("put").alias("op"), values.alias("value"))


def read(table: DataFrame, key: str, version: Column | int | None = None) -> DataFrame:
    """The rows at a version (the newest by default)."""
    return kv.newest(table, version).filter("op <> 'delete'").select(F.col("key").alias(key), "value.*")


def insert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    values = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema["value"].dataType.fields])
    return kv.append_batch(table, rows.select(F.col(key).alias("key"), F.lit(0).alias("ord"), F.lit("put").alias("op"), values.alias("value")))


def update(table: DataFrame, key: str, where: Column, **changes: Column) -> DataFrame:
    """Rows where ``where`` is true (not null) get ``changes``."""
    fields = [f.name for f in table.schema["value"].dataType.fields]
    hit = read(table, key).filter(where)
    values = F.struct(*[changes[c].cast(table.schema["value"].dataType[c].dataType).alias(c) if c in changes else F.col(c) for c in fields])
    return kv.append_batch(table, hit.select(F.col(key).alias("key"), F.lit(0).alias("ord"), F.lit("put").alias("op"), values.alias("value")))


def delete(table: DataFrame, key: str, where: Column) -> DataFrame:
    gone = read(table, key).filter(where)
    kind = table.schema["value"].dataType
    return kv.append_batch(table, gone.select(F.col(key).alias("key"), F.lit(0).alias("ord"), F.lit("delete").alias("op"), F.lit(None).cast(kind).alias("value")))
