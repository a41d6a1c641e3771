"""The range layer: lookups, generation-ordered merging, routing, splits, id blocks, merge and rebalance plans.

Descriptors have range_id, start, stop (half-open), generation, arrival and state. Merging works on the
elementary intervals between all bounds: of the descriptors that cover one, the greatest generation owns
it, and on a tie the one that came first. Bounds are longs; descriptors meet the intervals inside them in
buckets of the mean descriptor's length, by equality, so that nothing is compared with everything.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intervals import as_of, bucket_width, covering, running, with_next
from ..functions.scalar import crc32c


def contains(key: Column, start: Column, stop: Column) -> Column:
    return (key >= start) & (key < stop)


def elementary(descriptors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The intervals between neighbouring bounds of all non-empty descriptors."""
    good = descriptors.filter("start < stop")
    bounds = good.select(*by, F.explode(F.array("start", "stop")).alias("low")).distinct()
    return with_next(bounds, list(by), "low", "low", bucket_width(bounds, "low", "low"), "high").filter("high is not null")


def merge_generation(descriptors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(low, high, range_id, generation): who owns each covered elementary interval."""
    good = descriptors.filter("start < stop").select(*by, "start", "stop", "range_id", "generation", "arrival")
    owner = F.max_by(F.struct("range_id", "generation"), F.struct("generation", -F.col("arrival"))).alias("w")
    return covering(elementary(descriptors, by), good, "low", "start", "stop", list(by)).groupBy(*by, "low", "high").agg(owner).select(*by, "low", "high", "w.range_id", "w.generation")


def coalesce_intervals(owned: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Neighbouring intervals of one owner and generation as one: what runs on goes by windows of one descriptor each."""
    same = [*by, "range_id", "generation"]
    order = Window.partitionBy(*same).orderBy("low")
    fresh = F.when(F.lag("high").over(order) == F.col("low"), 0).otherwise(1)
    island = F.sum("fresh").over(order)
    return owned.withColumn("fresh", fresh).withColumn("island", island).groupBy(*same, "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def evict(owned: DataFrame, misses: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A client's map (merge_generation()) without the entries that hold a key (``by``, key) of a mismatch that named nothing."""
    entries = coalesce_intervals(owned, by)
    hit = covering(misses, entries, "key", "low", "high", list(by)).select(*by, "low").distinct()
    return entries.join(hit, [*by, "low"], "left_anti").select(*by, "low", "high", "range_id", "generation")


def leader_hints(events: DataFrame) -> DataFrame:
    """The leader that each client last heard of for a range; ``events`` (client, range_id, leader, seq), null to forget."""
    last = events.groupBy("client", "range_id").agg(F.max_by(F.struct("leader"), "seq").alias("h"))
    return last.filter("h.leader is not null").select("client", "range_id", "h.leader")


def lookup(keys: DataFrame, owned: DataFrame, key: str = "key") -> DataFrame:
    """``keys`` with the range that owns each: the interval of the greatest low at or below the key, if its high is above.

    An as-of join over disjoint intervals of longs: one sort, where a range join would compare. Keys are dealt to
    buckets of the map's span, so the keyspace isn't one task.
    """
    spans = owned.select(F.lit(0).alias("one"), F.col("low").alias(key), "high", "range_id", "generation")
    found = as_of(keys.withColumn("one", F.lit(0)), spans, ["one"], key, width=bucket_width(owned, "low", "high"))
    hit = F.col("found.high") > F.col(key)
    return found.select(*keys.columns, F.when(hit, F.col("found.range_id")).alias("range_id"), F.when(hit, F.col("found.generation")).alias("generation"))


def bucketed_lookup(keys: DataFrame, spans: DataFrame, width: int, key: str = "key") -> DataFrame:
    """Every (key, span) pair with the key inside, for long keys and spans that may overlap.

    Spans are dealt to the buckets of ``width`` that they meet, so the join is an equi-join on the bucket.
    """
    dealt = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    return keys.withColumn("bucket", F.floor(F.col(key) / width)).join(dealt, "bucket").filter(contains(F.col(key), F.col("start"), F.col("stop"))).drop("bucket")


def meta_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Intervals whose owner or generation differs between two merged maps over common cuts."""
    cut = elementary(before.select(F.col("low").alias("start"), F.col("high").alias("stop")).unionByName(after.select(F.col("low").alias("start"), F.col("high").alias("stop"))))

    def named(owned: DataFrame, tag: str) -> DataFrame:
        found = lookup(cut.select(F.col("low").alias("key"), "high"), owned)
        return found.select(F.col("key").alias("low"), "high", F.col("range_id").alias(f"{tag}_range"), F.col("generation").alias(f"{tag}_generation"))

    return named(before, "old").join(named(after, "new"), ["low", "high"]).filter(~(F.col("old_range").eqNullSafe(F.col("new_range")) & F.col("old_generation").eqNullSafe(F.col("new_generation"))))


def route(requests: DataFrame, descriptors: DataFrame) -> DataFrame:
    """The verdict on requests (request, key, range_id) that reached a range: applied, or out of its span, with every
    range that holds the key among ``descriptors``."""
    own = descriptors.select(F.col("range_id"), F.col("start").alias("own_start"), F.col("stop").alias("own_stop"), F.col("state").alias("own_state"))
    judged = requests.join(own, "range_id", "left")
    good = contains(F.col("key"), F.col("own_start"), F.col("own_stop")) & (F.col("own_state") != "subsumed")
    judged = judged.withColumn("verdict", F.when(F.coalesce(good, F.lit(False)), "applied").otherwise("out_of_span"))
    wrong = judged.filter("verdict <> 'applied'").select("request", "key")
    held = descriptors.select(F.col("range_id").alias("holder"), "start", "stop")
    holders = covering(wrong, held, "key", "start", "stop").groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_set("holder")), lambda h: h.cast("string")), ",").alias("holders"))
    return judged.join(holders, "request", "left").select("request", "range_id", "key", "verdict", F.coalesce("holders", F.lit("")).alias("holders"))


#: Why a split is refused, in the order judged.
SPLIT_REFUSALS = ("system", "outside", "not_live", "joint", "no_id")


def split_refusals(splits: DataFrame, descriptors: DataFrame, system: tuple[int, ...] = (1,)) -> DataFrame:
    """Each split (idx, range_id, split_at, right_id, joint) with its refusal against its range's descriptor, or null."""
    found = splits.join(descriptors.select("range_id", "start", "stop", "generation", "state"), "range_id", "left")
    inside = (F.col("split_at") > F.col("start")) & (F.col("split_at") < F.col("stop"))
    refusal = F.when(F.col("range_id").isin(*system), "system").when(~F.coalesce(inside, F.lit(False)), "outside").when(F.col("state") != "live", "not_live").when(F.col("joint"), "joint").when(F.col("right_id").isNull(), "no_id")
    return found.select("idx", "range_id", "split_at", "right_id", refusal.alias("refusal"), "start", "stop", "generation")


def split_once(splits: DataFrame, descriptors: DataFrame) -> DataFrame:
    """The two descriptors of each accepted split: [start, split_at) keeps the id, [split_at, stop) gets the new one, a generation up."""
    good = split_refusals(splits, descriptors).filter("refusal is null")
    halves = F.array(F.struct(F.col("range_id").alias("range_id"), F.col("start").alias("start"), F.col("split_at").alias("stop")), F.struct(F.col("right_id").alias("range_id"), F.col("split_at").alias("start"), F.col("stop").alias("stop")))
    return good.select("idx", (F.col("generation") + 1).alias("generation"), F.explode(halves).alias("d")).select("idx", "d.range_id", "d.start", "d.stop", "generation")


def split_lineage(splits: DataFrame, descriptors: DataFrame) -> DataFrame:
    """The descriptors after all splits in index order: later splits see what earlier ones of the same root made.

    A root's splits are applied one after another; roots are independent.
    """
    roots = descriptors.select(F.col("range_id").alias("root"), "start", "stop", "generation", "state")
    commands = splits.select(F.col("range_id").alias("root"), "idx", "split_at", "right_id", "joint")

    def fold(key: tuple, have: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        live = [(key[0], r.start, r.stop, r.generation, r.state) for r in have.itertuples()]
        for s in asked.sort_values("idx").itertuples():
            for k, (rid, start, stop, generation, state) in enumerate(live):
                if start < s.split_at < stop and state == "live" and not s.joint and not pd.isna(s.right_id):
                    live[k : k + 1] = [(rid, start, s.split_at, generation + 1, state), (int(s.right_id), s.split_at, stop, generation + 1, state)]
                    break
        return pd.DataFrame([(key[0], *d[:4]) for d in live], columns=["root", "range_id", "start", "stop", "generation"])

    return roots.groupBy("root").cogroup(commands.groupBy("root")).applyInPandas(fold, "root long, range_id long, start long, stop long, generation long")


def id_blocks(leases: DataFrame) -> DataFrame:
    """Disjoint blocks (first_id, last_id) from a counter that rises by each lease's size, in index order."""
    upto = running(leases.select("idx", "node", "size"), ["idx"], "size", F.sum, lambda a, b: a + b, before=False, name="upto")
    return upto.select("idx", "node", (F.col("upto") - F.col("size") + 1).alias("first_id"), F.col("upto").alias("last_id"))


def in_force(places: DataFrame, values: DataFrame, inclusive: bool) -> DataFrame:
    """The descriptor in force per range at an index (inclusive) or before it: ``places`` (range_id, idx, ...)."""
    return as_of(places, values, ["range_id"], "idx", inclusive)


def config_digest(nodes: DataFrame) -> DataFrame:
    """The CRC-32C of a bootstrap configuration, a stated small table: of its rows as lines in order, fields parted by a
    vertical bar and a missing one written \\N. The same whatever the order of the rows."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in nodes.columns]
    whole = nodes.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *fields))), "\n").alias("text"), F.count(F.lit(1)).alias("rows"))
    return whole.select(crc32c(F.encode("text", "UTF-8")).alias("digest"), "rows")


def reseed_pick(directories: DataFrame) -> DataFrame:
    """Per node the newest generation that isn't marked lost."""
    return directories.filter("not lost").groupBy("node").agg(F.max("generation").alias("generation"))


def cut_frames(messages: Iterable[tuple[int, int, int, int]], cap: int, head: int = 0, tag: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """(flush, place, range_id, seq, bytes) of one peer's messages (flush, range_id, seq, bytes; in order of flush and seq).

    A flush cuts one frame of at most ``cap`` bytes (``head`` and, for each message, ``tag`` more): it takes a
    message from each range in turn, from the range that the last frame left out first. A range whose next
    message doesn't fit waits for the next flush. Flushes go on after the last message until nothing waits;
    a message that fits no frame at all is refused, with flush and place -1.
    """
    queues: dict[int, deque[tuple[int, int]]] = {}
    resume: int | None = None

    def flush() -> Iterator[tuple[int, int, int, int]]:
        nonlocal resume
        turns = deque(sorted(queues))
        if resume in queues:
            turns.rotate(-turns.index(resume))
        used, place, left_out = head, 0, None
        while turns:
            range_id = turns.popleft()
            seq, size = queues[range_id][0]
            if used + tag + size > cap:
                left_out = range_id if left_out is None else left_out
                continue
            queues[range_id].popleft()
            yield place, range_id, seq, size
            used, place = used + tag + size, place + 1
            if queues[range_id]:
                turns.append(range_id)
            else:
                del queues[range_id]
        resume = left_out

    now = None
    for at, range_id, seq, size in messages:
        while now is not None and now < at and queues:
            yield from ((now, *m) for m in flush())
            now += 1
        now = at
        if head + tag + size > cap:
            yield -1, -1, range_id, seq, size
        else:
            queues.setdefault(range_id, deque()).append((seq, size))
    while queues:
        yield from ((now, *m) for m in flush())
        now += 1


def outbox_frames(messages: DataFrame, cap: int, head: int = 0, tag: int = 0) -> DataFrame:
    """Each message (peer, flush, range_id, seq, bytes) with the flush whose frame carries it, and its place there (see cut_frames).

    A peer's queue is sequential: one peer is one task, through which its messages stream.
    """

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in frames for r in zip(*(pdf[c].tolist() for c in ("flush", "range_id", "seq", "bytes")), strict=True))
        found = cut_frames(rows, cap, head, tag)
        while lot := list(islice(found, 10_000)):
            yield pd.DataFrame([(key[0], *r) for r in lot], columns=["peer", "flush", "place", "range_id", "seq", "bytes"])

    ordered = messages.select(F.col("peer").cast("long").alias("peer"), *[F.col(c).cast("long").alias(c) for c in ("flush", "range_id", "seq", "bytes")])
    ordered = ordered.repartition("peer").sortWithinPartitions("peer", "flush", "seq")
    return ordered.groupBy("peer").applyInPandas(run, "peer long, flush long, place long, range_id long, seq long, bytes long")


def frame_sizes(framed: DataFrame) -> DataFrame:
    """Per frame its messages, ranges and bytes."""
    return framed.filter("flush >= 0").groupBy("peer", "flush").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("range_id").alias("ranges"), F.sum("bytes").alias("bytes"))


def merge_candidates(descriptors: DataFrame) -> DataFrame:
    """Adjacent live ranges that could become one: the left id, both spans, one generation above both."""
    left = descriptors.filter("state = 'live'").select(F.col("range_id").alias("left_id"), "start", F.col("stop").alias("edge"), F.col("generation").alias("left_generation"))
    right = descriptors.filter("state = 'live'").select(F.col("range_id").alias("right_id"), F.col("start").alias("edge"), "stop", F.col("generation").alias("right_generation"))
    return left.join(right, "edge").filter("left_id <> right_id").select("left_id", "right_id", "start", "edge", "stop", (F.greatest("left_generation", "right_generation") + 1).alias("generation"))


def rebalance_move(replicas: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """The next replica to move (range_id, from_node, to_node), or no row if every node is near the mean.

    From the fullest node to the emptiest, ties to the least node; the least range that the target lacks.
    """
    loads = replicas.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ends = loads.agg(F.max_by("node", F.struct("n", -F.col("node"))).alias("from_node"), F.min_by("node", F.struct("n", "node")).alias("to_node"), F.max("n").alias("most"), F.min("n").alias("least"), F.avg("n").alias("mean"))
    ends = ends.filter((F.col("most") > F.col("mean") * (1 + tolerance)) & (F.col("most") - F.col("least") > 1))
    here = replicas.join(F.broadcast(ends), replicas["node"] == ends["from_node"]).select("range_id", "from_node", "to_node")  # one row
    there = replicas.select(F.col("range_id"), F.col("node").alias("to_node"))
    return here.join(there, ["range_id", "to_node"], "left_anti").groupBy("from_node", "to_node").agg(F.min("range_id").alias("range_id"))
