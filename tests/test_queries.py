"""Every query with SQL gives what DuckDB gives on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = Path("/root/testdata/sf0.001")
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def shown(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def in_order(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(shown(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF.iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert in_order(df.columns, [tuple(r) for r in df.collect()]) == in_order(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if not n.startswith("op") and n != "pipeline"))
def test_without_sql_agrees_with_itself_whatever_the_partitions(spark, name):
    """No query without SQL is empty here, and none depends on how rows are dealt to tasks."""
    first = in_order((df := QUERIES[name](spark, str(SF))).columns, [tuple(r) for r in df.collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        again = in_order(df.columns, [tuple(r) for r in QUERIES[name](spark, str(SF)).collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first and first == again


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
