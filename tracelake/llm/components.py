"""Connected components of an undirected graph, by alternating large and small stars.

Each round rewires every node to the smallest neighbour it knows (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014); rounds grow with the logarithm of the longest path.
Each round is written to the shared checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, shared_checkpoint


def _minima(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour. The node is renamed by an expression, so that Spark shuffles these rows anew for a
    join: only then can it split the edges of a hub among several tasks."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("u"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minima(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the smallest node reachable.

    No edges give no rows; self-loops and repeated edges change nothing.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    now = shared_checkpoint(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct())
    before = mark(now)
    while before[0]:
        last, now = now, shared_checkpoint(_small_star(_large_star(now)))
        drop_table(last)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
