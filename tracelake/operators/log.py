"""The replicated command log: replay, outcomes, deduplication, quorums and commit indices.

Puts and deletes need only the last write of a key; compare-and-set depends on order, so those outcomes
are replayed key by key. A key's commands are the unit of that replay, in order of (index).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import majority, majority_index

OUTCOMES = "idx long, kind string, outcome string, swapped boolean, held long"


def step(kind: str, value: int | None, expect: int | None, held: int | None) -> tuple[str, bool | None, int | None, int | None]:
    """One command on one register: (outcome, swapped, value read, value held after)."""
    if kind == "put":
        return "done", None, None, value
    if kind == "delete":
        return "done", None, None, None
    if kind == "cas":
        same = held == expect  # absent equals absent
        return "swapped", same, None, value if same else held
    if kind == "get":
        return "value", None, held, held
    return "noop", None, None, held


def cas_outcomes(commands: DataFrame, by: tuple[str, ...] = ("range_id", "key")) -> DataFrame:
    """The outcome of every command (idx, kind, value, expect: null means absent), replayed per key in index order."""

    def replay(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: int | None = None
        for pdf in frames:  # batches of one key, in index order: a hot key streams through
            out = []
            for idx, kind, value, expect in zip(pdf["idx"], pdf["kind"], pdf["value"], pdf["expect"], strict=True):
                outcome, swapped, read, held = step(kind, None if pd.isna(value) else int(value), None if pd.isna(expect) else int(expect), held)
                out.append((*key, idx, kind, outcome, swapped, read))
            frame = pd.DataFrame(out, columns=[*by, "idx", "kind", "outcome", "swapped", "held"])
            yield frame.astype({"held": "Int64", "swapped": "boolean"})

    keys = ", ".join(f"{k} {commands.schema[k].dataType.simpleString()}" for k in by)

    # sorted before it is grouped, so that each key's batches come in order
    ordered = commands.select(*by, "idx", "kind", "value", "expect").repartition(*by).sortWithinPartitions(*by, "idx")
    return ordered.groupBy(*by).applyInPandas(replay, f"{keys}, {OUTCOMES}")


def replay_puts(commands: DataFrame, upto: Column | int | None = None) -> DataFrame:
    """Live (range_id, key, value) after the puts and deletes up to an index: the last one of a key decides."""
    writes = commands.filter(F.col("kind").isin("put", "delete"))
    writes = writes if upto is None else writes.filter(F.col("idx") <= upto)
    last = writes.groupBy("range_id", "key").agg(F.max_by(F.struct("idx", "kind", "value"), "idx").alias("w"))
    return last.filter("w.kind = 'put'").select("range_id", "key", "w.idx", "w.value")


def dedup_requests(commands: DataFrame) -> DataFrame:
    """The first entry of each (range, client, request): a request sent again is proposed once."""
    return commands.groupBy("range_id", "client", "client_seq").agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("sent"))


def commit_indices(matches: DataFrame, voters: list[int], joining: list[int] | None = None) -> DataFrame:
    """Per range the greatest index that a majority of the voters (and of the joining ones) holds; absent servers hold 0."""

    def reached(servers: list[int]) -> Column:
        own = [F.coalesce(F.max(F.when(F.col("server") == s, F.col("match_index"))), F.lit(0)) for s in servers]
        return majority_index(F.array(*own), F.array(*[F.lit(s) for s in servers]))

    best = reached(voters) if joining is None else F.least(reached(voters), reached(joining))
    return matches.groupBy("range_id").agg(best.cast("long").alias("commit_index"))


def commit_rule(reached: DataFrame, terms: DataFrame, current: Column | int) -> DataFrame:
    """Commit indices whose entry is of the current term; others wait for one of it."""
    return reached.join(terms, (reached["range_id"] == terms["range_id"]) & (reached["commit_index"] == terms["idx"])).filter(F.col("term") == current).select(reached["range_id"], "commit_index", "term")


def grants_by_majority(votes: DataFrame, voters: list[int]) -> DataFrame:
    """(range_id, term): granted voters and whether they are a majority."""
    granted = F.array_sort(F.collect_set(F.when(F.col("granted"), F.col("node"))))
    return votes.groupBy("range_id", "term").agg(granted.alias("granted")).select("range_id", "term", F.size("granted").cast("long").alias("granted"), majority(F.col("granted"), F.array(*[F.lit(v) for v in voters])).alias("won"))


def truncations(entries: DataFrame, cuts: DataFrame) -> DataFrame:
    """Entries (range_id, server, idx, seq) that no later cut (from_idx, seq) of their server removed.

    An entry goes if some cut with from_idx <= idx comes after it: the cuts' least from_idx after each
    entry decides, a running minimum from the end, in one window per server.
    """
    both = entries.select("range_id", "server", "seq", "idx", F.lit(None).cast("long").alias("cut"), *[c for c in entries.columns if c not in ("range_id", "server", "seq", "idx")])
    marks = cuts.select("range_id", "server", "seq", F.lit(None).cast("long").alias("idx"), F.col("from_idx").alias("cut"))
    later = Window.partitionBy("range_id", "server").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)  # a running frame; one to the end would be summed anew for each row
    return both.unionByName(marks, allowMissingColumns=True).withColumn("least", F.min("cut").over(later)).filter("idx is not null and (least is null or least > idx)").drop("cut", "least")
