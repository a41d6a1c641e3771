"""A replica's own state: its keys, what one version shows of it, its log's bounds, its reads, its ids, its start.

All of a group's state lies in one key interval: 8 bytes of tenant, 8 of group, 8 of purpose, then a name,
big-endian, so that byte order is the order of numbers and a span is a range of keys that scans push down.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intervals import as_of, bucket_width
from ..functions.scalar import majority
from .measure import commit_stamps

#: What the keys of a group hold, by purpose; the first id that isn't a system range's; the first generation.
PURPOSES = {"meta": 0, "log": 1, "config": 2, "snapshot": 3, "descriptor": 4}
FIRST_USER_RANGE = 2
FIRST_GENERATION = 1
FOREVER = 1 << 62


def _big_endian(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def state_key(group: Column, purpose: Column, name: Column) -> Column:
    """The key of a name (binary) among a group's state of one purpose; the tenant is 0."""
    return F.concat(F.unhex(F.lit("00" * 8)), _big_endian(group), _big_endian(purpose), name)


def state_span(group: int, purpose: int | None = None) -> tuple[bytes, bytes]:
    """[start, stop) of all of a group's keys, or of those of one purpose; the last group's span ends with the tenant."""
    last = (1 << 64) - 1
    after_group = struct.pack(">QQ", 0, group + 1) if group < last else struct.pack(">Q", 1)
    if purpose is None:
        return struct.pack(">QQ", 0, group), after_group
    return struct.pack(">QQQ", 0, group, purpose), struct.pack(">QQQ", 0, group, purpose + 1) if purpose < last else after_group


def in_state(key: Column, group: int, purpose: int | None = None) -> Column:
    start, stop = state_span(group, purpose)
    return (key >= F.lit(start)) & (key < F.lit(stop))


def apply_batches(commands: DataFrame) -> DataFrame:
    """Commands (range_id, idx, key, kind, value) as the batches that apply them: each writes its key and the range's
    applied index together, at version idx. Columns: range_id, name, seq, ord, op, value."""
    writes = commands.filter("kind in ('put', 'delete')").select("range_id", F.concat(F.lit("k/"), "key").alias("name"), F.col("idx").alias("seq"), F.lit(0).alias("ord"), F.col("kind").alias("op"), F.when(F.col("kind") == "put", F.col("value")).alias("value"))
    applied = commands.select("range_id", F.lit("applied").alias("name"), F.col("idx").alias("seq"), F.lit(1).alias("ord"), F.lit("put").alias("op"), F.col("idx").alias("value"))
    return writes.unionByName(applied)


def reads_at(batches: DataFrame, reads: DataFrame) -> DataFrame:
    """Each read (read_id, range_id, key, version) with the key's value and the applied index (0 where there is none),
    both from the one version that it names."""
    asked = F.array(F.concat(F.lit("k/"), F.col("key")), F.lit("applied"))
    wanted = reads.select("read_id", "range_id", F.col("version").alias("seq"), F.posexplode(asked).alias("part", "name"))
    newest = batches.groupBy("range_id", "name", "seq").agg(F.max_by(F.struct("op", "value"), "ord").alias("w"))
    found = as_of(wanted, newest, ["range_id", "name"], "seq", width=bucket_width(batches, "seq", "seq"))
    value = F.when(F.col("found.w.op") == "put", F.col("found.w.value"))
    return found.groupBy("read_id", "range_id").agg(F.max(F.when(F.col("part") == 0, value)).alias("value"), F.coalesce(F.max(F.when(F.col("part") == 1, value)), F.lit(0).cast("long")).alias("applied"))


def above_floor(appends: DataFrame, floors: DataFrame) -> DataFrame:
    """The appends of indices above their replica's last floor. What ends an entry is another of its index or a cut, so
    log_view() of these alone has the same entries above it."""
    last = floors.filter("to_seq is null").select("range_id", "server", "floor")
    return appends.join(F.broadcast(last), ["range_id", "server"], "left").filter("floor is null or idx > floor").drop("floor")  # a row a replica


def retained(entries: DataFrame, floors: DataFrame) -> DataFrame:
    """What a replica's log holds at the end: entries alive (``entries``: log_view()) above its last floor (``floors``)."""
    last = floors.filter("to_seq is null").select("range_id", "server", "floor")
    held = entries.filter("to_seq is null").join(last, ["range_id", "server"], "left")
    return held.filter("floor is null or idx > floor").select("range_id", "server", "idx", "term", "hash")


def log_bounds(kept: DataFrame, floors: DataFrame) -> DataFrame:
    """Per replica the first index its log may hold, one past its floor, and the last it holds."""
    last = floors.filter("to_seq is null").select("range_id", "server", "floor")
    ends = kept.groupBy("range_id", "server").agg(F.max("idx").alias("top"))
    both = ends.join(last, ["range_id", "server"], "full").withColumn("floor", F.coalesce("floor", F.lit(0).cast("long")))
    return both.select("range_id", "server", (F.col("floor") + 1).alias("first_index"), F.greatest(F.coalesce("top", "floor"), "floor").alias("last_index"))


def hard_state(persisted: DataFrame) -> DataFrame:
    """Per replica the term and vote after a restart: those of its greatest term, and there of the last batch that was
    durable. ``persisted``: range_id, server, term, voted_for, durable, seq."""
    kept = persisted.filter("durable").groupBy("range_id", "server").agg(F.max_by(F.struct("term", "voted_for"), F.struct("term", "seq")).alias("h"))
    return kept.select("range_id", "server", "h.term", "h.voted_for")


def read_index(reads: DataFrame, acks: DataFrame, commits: DataFrame, applies: DataFrame, voters: list[int]) -> DataFrame:
    """What becomes of reads at leaders: the index each must see, when a majority confirmed it, and when it was served.

    ``reads``: read_id, range_id, server, first_of_term, seq, t, lease_until (null: no lease), able (the servers
    that could still confirm it). ``acks``: read_id, server, seq. A read is refused if no lease holds and
    those able and itself are no majority. It needs the greater of the commit index then and the first
    index of the leader's term, and is served once confirmed and applied so far; else it waits.
    """
    set_of = F.array(*[F.lit(v).cast("long") for v in voters])
    rises = commits.select("range_id", "server", "seq", F.max("idx").over(Window.partitionBy("range_id", "server").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("high"))
    placed = as_of(reads, rises, ["range_id", "server"], "seq", value="committed")
    first = acks.groupBy("read_id", "server").agg(F.min("seq").alias("acked")).withColumnRenamed("server", "follower")
    heard = placed.select("read_id", F.col("server").alias("leader"), F.col("seq").alias("asked")).join(first, "read_id").filter(F.col("follower").isin(*voters) & (F.col("follower") != F.col("leader")) & (F.col("acked") > F.col("asked")))
    heard = heard.groupBy("read_id").agg(F.array_sort(F.collect_list("acked")).alias("heard"))
    own = F.when(F.array_contains(set_of, F.col("server").cast("long")), 1).otherwise(0)
    needed = F.lit(len(voters) // 2 + 1) - own
    lease = F.coalesce(F.col("lease_until") >= F.col("t"), F.lit(False))
    refused = ~lease & ~majority(F.array_union(F.col("able").cast("array<bigint>"), F.array(F.col("server").cast("long"))), set_of)
    confirmed = F.when(lease | (needed <= 0), F.col("seq")).otherwise(F.get("heard", (needed - 1).cast("int")))
    judged = placed.join(heard, "read_id", "left").select("read_id", "range_id", "server", F.greatest(F.coalesce("committed.high", F.lit(0).cast("long")), "first_of_term").alias("idx"), F.when(~refused, confirmed).alias("confirmed"), refused.alias("refused"))
    reached = commit_stamps(applies).select("range_id", "server", "idx", F.col("stamp_seq").alias("applied"))
    seen = judged.join(reached, ["range_id", "server", "idx"], "left")
    served = F.when(F.col("confirmed").isNotNull() & F.col("applied").isNotNull(), F.greatest("confirmed", "applied"))
    fate = F.when(F.col("refused"), "refused").when(served.isNotNull(), "served").when(F.col("confirmed").isNull(), "unconfirmed").otherwise("unapplied")
    return seen.select("read_id", "range_id", "server", F.col("idx").alias("index"), "confirmed", F.when(~F.col("refused"), served).alias("served"), fate.alias("fate"))


def lease_reads_at_risk(reads: DataFrame, revoked: DataFrame, clocks: DataFrame, bound_ppm: int) -> DataFrame:
    """Reads served under a lease (read_id, range_id, server, term, key, seq) while some voter's clock drifted from the
    leader's by more than the bound, without a revocation (range_id, server, term, seq) of that lease before them.

    ``clocks``: server, drift_ppm; one row a server of the range's voters. Whether such a read was stale is for the
    linearizability of its key to tell: see unsafe_lease_reads().
    """
    ends = clocks.agg(F.min("drift_ppm").alias("least"), F.max("drift_ppm").alias("most"))
    far = clocks.crossJoin(F.broadcast(ends)).filter(F.greatest(F.col("drift_ppm") - F.col("least"), F.col("most") - F.col("drift_ppm")) > bound_ppm).select("server")  # one row beside each
    first = revoked.groupBy("range_id", "server", "term").agg(F.min("seq").alias("revoked"))
    risky = reads.join(far, "server").join(first, ["range_id", "server", "term"], "left")
    return risky.filter("revoked is null or revoked > seq").select("read_id", "range_id", "server", "term", "key", "seq")


def unsafe_lease_reads(risky: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Reads at risk whose key's history (lin.verdicts()) isn't linearizable, or couldn't be decided."""
    return risky.join(verdicts.filter("status <> 'ok'").select("key", "status"), "key").select("read_id", "range_id", "server", "term", "key", "status", "seq")


def id_takes(adoptions: DataFrame, takes: DataFrame) -> DataFrame:
    """The id that each split (node, run, seq) takes from the block its node's run holds then, or null where none is left.

    ``adoptions`` (node, run, granted_run, first_id, last_id, seq): a run adopts only blocks granted to it, each once,
    and a new block takes the place of what was left of the one before.
    """
    own = adoptions.filter("run = granted_run").groupBy("node", "run", "first_id").agg(F.min(F.struct("seq", "last_id")).alias("a")).select("node", "run", "a.seq", F.struct("first_id", "a.last_id").alias("block"))
    rows = own.withColumn("take", F.lit(False)).unionByName(takes.select("node", "run", "seq", F.lit(None).cast(own.schema["block"].dataType).alias("block"), F.lit(True).alias("take")))
    by = Window.partitionBy("node", "run").orderBy("seq", "take")
    epochs = rows.withColumn("epoch", F.count("block").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = Window.partitionBy("node", "run", "epoch").orderBy("seq", "take")
    placed = epochs.withColumn("held", F.first("block", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("nth", F.count_if(F.col("take")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    taken = F.col("held.first_id") + F.col("nth") - 1
    return placed.filter("take").select("node", "run", "seq", F.when(taken <= F.col("held.last_id"), taken).alias("id"))


def bootstrap_state(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first state of a cluster as rows (kind, name, value): a descriptor a range, a meta record a user range by its end,
    the counter past the highest id, a record a node, and a digest of the configuration that every node computes alike.

    ``spans``: range_id, start, stop; ``nodes``: node, address. Ids below FIRST_USER_RANGE are system ranges.
    """
    voters = nodes.agg(F.array_join(F.array_sort(F.collect_list(F.col("node").cast("string"))), ",").alias("voters"))
    named = spans.crossJoin(F.broadcast(voters))  # one row
    told = F.concat_ws(" ", F.col("range_id"), F.col("start"), F.col("stop"), F.lit(str(FIRST_GENERATION)), F.col("voters"))
    user = named.filter(F.col("range_id") >= FIRST_USER_RANGE)
    counter = spans.agg(F.greatest(F.lit(FIRST_USER_RANGE).cast("long"), F.coalesce(F.max("range_id"), F.lit(0)) + 1).alias("n"))
    config = spans.select(F.concat_ws(" ", F.lit("range"), "range_id", "start", "stop").alias("line")).unionByName(nodes.select(F.concat_ws(" ", F.lit("node"), "node", "address").alias("line")))
    digest = config.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256).alias("d"))  # the bootstrap's few ranges and nodes
    parts = [
        named.select(F.lit("descriptor").alias("kind"), F.col("range_id").cast("string").alias("name"), told.alias("value")),
        user.select(F.lit("meta").alias("kind"), F.col("stop").cast("string").alias("name"), told.alias("value")),
        counter.select(F.lit("counter").alias("kind"), F.lit("").alias("name"), F.col("n").cast("string").alias("value")),
        nodes.select(F.lit("node").alias("kind"), F.col("node").cast("string").alias("name"), F.col("address").alias("value")),
        digest.select(F.lit("digest").alias("kind"), F.lit("").alias("name"), F.col("d").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
