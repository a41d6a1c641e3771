"""Measures over traces: lags, holds, coverage, rates, gaps in availability, convergence, and sweep results.

Times are nanoseconds. Medians are lower medians. A replica's commit advances stamp each index once, when
the highest committed index first passes it; a later commit never stamps an index again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intervals import as_of, bucket_width, covering, overlapping, running, with_next

#: Fixed value: the least span in seconds that a rate divides by.
EPSILON = 2.220446049250313e-16


def commit_stamps(commits: DataFrame) -> DataFrame:
    """(range_id, server, idx, stamp, stamp_seq): when each index was first covered by a commit of its replica."""
    by = Window.partitionBy("range_id", "server").orderBy("seq", "idx")
    high = F.max("idx").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rises = commits.withColumn("before", F.coalesce(high, F.lit(0).cast("long"))).filter("idx > before")
    return rises.select("range_id", "server", F.explode(F.sequence(F.col("before") + 1, F.col("idx"))).alias("idx"), F.col("t").alias("stamp"), F.col("seq").alias("stamp_seq"))


def apply_lag(applies: DataFrame, commits: DataFrame) -> DataFrame:
    """(range_id, server, idx, lag) of every apply whose index was stamped by then."""
    stamps = commit_stamps(commits)
    return applies.select("range_id", "server", "idx", "t").join(stamps, ["range_id", "server", "idx"]).filter("t >= stamp").select("range_id", "server", "idx", (F.col("t") - F.col("stamp")).alias("lag"))



def lag_medians(lags: DataFrame, threshold: int) -> DataFrame:
    """Lower median and count per range, and of all ranges together (range_id null), with whether it passes the threshold."""
    view = lags.select("range_id", "lag")
    out = view.sparkSession.sql("SELECT range_id, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY lag) AS BIGINT) AS median_lag, count(*) AS n FROM {lags} GROUP BY ROLLUP (range_id)", lags=view)
    return out.withColumn("slow", F.col("median_lag") > threshold)


def cross_hold(applies: DataFrame, commits: DataFrame, downs: DataFrame) -> DataFrame:
    """How long a ready entry of one range waited while its server applied another range's.

    Of a server's consecutive applies at t0 and t1 (of range A) and then of range B, where B's index was ready
    by t1, the hold is t1 - max(ready, t0); a crash or restart of the server inside drops it.
    """
    by = Window.partitionBy("server").orderBy("seq", "range_id")
    ordered = applies.select("server", "range_id", "idx", "seq", "t").withColumn("t1", F.lag("t", 1).over(by)).withColumn("t0", F.lag("t", 2).over(by)).withColumn("prior", F.lag("range_id", 1).over(by))
    turned = ordered.filter("prior is not null and prior <> range_id and t0 is not null")
    ready = turned.join(commit_stamps(commits), ["range_id", "server", "idx"]).filter("stamp <= t1")
    holds = ready.select("server", "range_id", "idx", F.greatest("stamp", "t0").alias("held_from"), F.col("t1").alias("held_until"))
    # the last crash or restart up to its end tells whether one fell inside
    last = as_of(holds.withColumn("at", F.col("held_until")), downs.select("server", F.col("down_t").alias("at")).distinct(), ["server"], "at", value="down")
    return last.select("server", "range_id", "idx", (F.col("held_until") - F.col("held_from")).alias("hold"), F.coalesce(F.col("down.at") >= F.col("held_from"), F.lit(False)).alias("dropped"))


def hold_summary(holds: DataFrame) -> DataFrame:
    kept = holds.withColumn("kept", F.when(~F.col("dropped"), F.col("hold")))
    return kept.sparkSession.sql("SELECT CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY kept) AS BIGINT) AS median_hold, max(kept) AS max_hold, count_if(dropped) AS dropped FROM {kept}", kept=kept)


def coverage(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of what a trace (event_type, range_id, v, user_id, seq) holds, in one pass."""
    named = {"clicks": "click", "errors": "error", "purchases": "purchase", "signups": "signup", "views": "view"}
    counts = [F.count_if(F.col("event_type") == event).alias(name) for name, event in named.items()]
    return lines.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), *counts, F.max("v").alias("max_index"), F.coalesce(F.bool_or(F.col("v") > 99), F.lit(False)).alias("any_high"), F.countDistinct("user_id").alias("clients"))


#: Counters that count the lines of one event.
EVENT_COUNTERS = {"partitions": "partition_started", "crashes": "node_crashed", "leaders": "raft_leader", "truncations": "raft_truncate", "commits": "raft_commit", "applies": "raft_apply", "snapshot_actions": "raft_snapshot", "client_mismatches": "client_mismatch", "client_sends": "client_send", "ids_leased": "range_ids_leased", "splits": "range_split"}
_DATA = "range_id long, idx long, term long, op string, dup boolean, won long"


def coverage_counters(lines: DataFrame) -> DataFrame:
    """What a run's trace lines (run files' columns) cover, in one pass: one row of counters. Data is parsed once a line."""
    rows = lines.select("seq", "t", "kind", "event", "fault", F.from_json("data", _DATA).alias("d"))
    is_event = lambda name: F.coalesce(F.col("event") == name, F.lit(False))
    counts = [F.count_if(is_event(event)).alias(name) for name, event in EVENT_COUNTERS.items()]
    ops = [F.count_if(is_event("client_invoke") & (F.col("d.op") == op)).alias(name) for op, name in (("put", "puts"), ("get", "gets"), ("delete", "deletes"), ("cas", "cas"))]
    applied = is_event("meta_applied") & (F.col("d.idx") > 0)
    return rows.agg(
        F.count(F.lit(1)).alias("records"), F.min_by("t", "seq").alias("first_t"), F.max_by("t", "seq").alias("last_t"), *counts, *ops,
        F.count_if((F.col("kind") == "deliver") & F.col("d.dup")).alias("duplicates"), F.count_if((F.col("kind") == "drop") & (F.col("fault") == "injected")).alias("drops"),
        F.coalesce(F.bool_or(is_event("raft_leader") & (F.col("d.term") > 1)), F.lit(False)).alias("terms_above_one"),
        F.coalesce(F.max(F.when(F.col("event").isin("raft_append", "raft_commit", "raft_apply"), F.col("d.idx"))), F.lit(0)).cast("long").alias("highest_index"),
        F.count_if(is_event("raft_read") & (F.col("d.range_id") <= 1)).alias("lookups_served"), F.count_if(applied).alias("meta_applies"), F.count_if(applied & (F.col("d.won") > 0)).alias("meta_took"),
    )


def coverage_groups(lines: DataFrame) -> DataFrame:
    """The counters that go by range, kind or place: (counter, name, n)."""
    rows = lines.select("event", F.from_json("data", "range_id string, op string").alias("d")).select("event", "d.range_id", "d.op")
    counted = rows.groupBy("event", "range_id", "op").agg(F.count(F.lit(1)).alias("n"))
    is_event = lambda name: F.col("event") == name
    named = [
        F.when(F.col("range_id").isNotNull(), F.struct(F.lit("records").alias("counter"), F.col("range_id").alias("name"))),
        F.when(is_event("raft_leader"), F.struct(F.lit("leaders").alias("counter"), F.col("range_id").alias("name"))),
        F.when(is_event("raft_apply"), F.struct(F.lit("applies").alias("counter"), F.col("range_id").alias("name"))),
        F.when(is_event("inbox_dropped"), F.struct(F.lit("inbox_drops").alias("counter"), F.concat("op", F.lit("/"), "range_id").alias("name"))),
        F.when(is_event("range_mismatch_sent"), F.struct(F.lit("mismatches").alias("counter"), F.col("op").alias("name"))),
    ]
    return counted.select("n", F.explode(F.array_compact(F.array(*named))).alias("c")).groupBy("c.counter", "c.name").agg(F.sum("n").alias("n"))


def rates(lines: DataFrame) -> DataFrame:
    """Per range: records, observed span in seconds, and records a second."""
    spans = lines.groupBy("range_id").agg(F.count(F.lit(1)).alias("records"), ((F.max("t") - F.min("t")) / 1e9).alias("seconds"))
    return spans.withColumn("per_second", F.col("records") / F.greatest("seconds", F.lit(EPSILON)))


def overall_rate(lines: DataFrame) -> DataFrame:
    """Observed span of the whole trace, records a second a range, and the busiest range's rate."""
    own = rates(lines)
    whole = lines.agg(F.count(F.lit(1)).alias("records"), ((F.max("t") - F.min("t")) / 1e9).alias("seconds"), F.countDistinct("range_id").alias("ranges"))
    return whole.crossJoin(own.agg(F.max("per_second").alias("busiest"))).select("seconds", (F.col("records") / F.col("ranges") / F.greatest("seconds", F.lit(EPSILON))).alias("per_range"), "busiest")  # one row each


def availability_gap(completions: DataFrame, outages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The longest time between neighbouring completions, less what outages (from_t, until_t) cover of it.

    With fewer than two completions there is none. Outages meet the gaps that they overlap in buckets of time.
    """
    by = by or []
    keyed = completions if by else completions.withColumn("all", F.lit(0))
    keys = by or ["all"]
    gaps = with_next(keyed.select(*keys, "t", "seq"), keys, "t", "seq", bucket_width(completions, "t", "t"), "next_t").filter("next_t is not null")
    met = overlapping(gaps, outages.select("from_t", "until_t"), ("t", "next_t"), ("from_t", "until_t"))
    out = met.groupBy(*keys, "seq").agg(F.sum(F.least("next_t", "until_t") - F.greatest("t", "from_t")).alias("covered"))
    left = gaps.join(out, [*keys, "seq"], "left")
    worst = left.groupBy(*keys).agg(F.max(F.col("next_t") - F.col("t") - F.coalesce("covered", F.lit(0))).alias("gap"))
    return worst.select(*by, "gap")


def meta_lag(updates: DataFrame, wanted: DataFrame, last_heal: int) -> DataFrame:
    """Per wanted range (range_id, start, stop, since): how long after it was due the meta map named all of its span
    to stay: from the last update that changed one of its intervals to it. Null if the final map names another.

    ``updates`` (idx, range_id, start, stop, generation, t) win an interval unless an earlier one named it higher.
    """
    from .ranges import elementary

    both = updates.select("start", "stop").unionByName(wanted.select("start", "stop"))
    cut = elementary(both)
    cut = cut.select("low")
    named = covering(cut, updates.select("start", "stop", "idx", "range_id", "generation", "t"), "low", "start", "stop").select("low", "idx", "range_id", "generation", "t")
    best = F.max("generation").over(Window.partitionBy("low").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    won = named.withColumn("best", best).filter("best is null or generation > best")
    order = Window.partitionBy("low").orderBy("idx")
    turns = won.withColumn("owner_before", F.lag("range_id").over(order)).filter("owner_before is null or owner_before <> range_id")
    last = turns.groupBy("low").agg(F.max_by(F.struct("range_id", "t"), "idx").alias("w")).select("low", F.col("w.range_id").alias("owner"), F.col("w.t").alias("named_t"))
    w = wanted.select(F.col("range_id").alias("want"), F.col("start").alias("w_start"), F.col("stop").alias("w_stop"), "since")
    spans = covering(cut, w, "low", "w_start", "w_stop").join(last, "low", "left")
    done = spans.groupBy("want", "since").agg(F.min(F.coalesce(F.col("owner") == F.col("want"), F.lit(False))).alias("named"), F.max("named_t").alias("at"))
    lag = F.greatest(F.col("at") - F.greatest(F.col("since"), F.lit(last_heal)), F.lit(0))
    return done.select(F.col("want").alias("range_id"), F.when(F.col("named"), lag).alias("lag"))


def meta_resends(updates: DataFrame) -> DataFrame:
    """Updates of a generation above 1 that won an interval which an earlier one named at theirs or newer: 0 on a good run."""
    from .ranges import elementary

    firsts = updates.groupBy("idx").agg(F.min_by(F.struct("start", "stop", "generation"), "seq").alias("u")).select("idx", "u.start", "u.stop", "u.generation")
    named = covering(elementary(firsts).select("low"), firsts, "low", "start", "stop").select("low", "idx", "generation")
    best = F.max("generation").over(Window.partitionBy("low").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return named.withColumn("best", best).filter("generation > 1 and best >= generation").agg(F.countDistinct("idx").alias("resends"))


def latest_spans(values: DataFrame) -> DataFrame:
    """The span of each range's last descriptor."""
    last = values.groupBy("range_id").agg(F.max_by(F.struct("start", "stop", "generation"), F.struct("idx", -F.col("seq"))).alias("v"))
    return last.select("range_id", "v.start", "v.stop", "v.generation")


def splits_from_earlier_run(splits: DataFrame, grants: DataFrame, restarts: DataFrame) -> DataFrame:
    """The first split whose right id lies in a block granted before its holder's latest restart before the split."""
    blocks = grants.select("node", "first_id", (F.col("last_id") + 1).alias("after_id"), F.col("seq").alias("granted"))
    held = covering(splits.select("seq", "right_id"), blocks, "right_id", "first_id", "after_id").select("seq", "right_id", "node", "granted")
    late = as_of(held, restarts.select("node", "seq"), ["node"], "seq", inclusive=False, value="restart").filter(F.col("restart.seq") > F.col("granted"))
    return late.agg(F.min(F.struct("seq", "node", "right_id")).alias("x")).filter("x is not null").select("x.seq", "x.right_id", "x.node")


def stale_reads_served(returns: DataFrame, reader_bits: int) -> DataFrame:
    """Completions of clients whose id carries the reader bits above bit 32."""
    return returns.agg(F.count_if(F.shiftright("client", 32).bitwiseAND(F.lit(reader_bits)) == reader_bits).alias("served"))


def losses(lines: DataFrame) -> DataFrame:
    """Counts by kind of loss and node."""
    return lines.groupBy("node", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def retries(sends: DataFrame) -> DataFrame:
    """Per operation (client, invoked): sends, and how many distinct generations they went to."""
    return sends.groupBy("client", "invoked").agg(F.count(F.lit(1)).alias("sent"), F.countDistinct("generation").alias("generations"))


def sweep_verdict(results: DataFrame) -> DataFrame:
    """Of a sweep (seed, failed): the first failing seed and the list of the others; no row if all pass."""
    bad = results.filter("failed").select("seed").distinct()
    found = bad.agg(F.min("seed").alias("first_seed"), F.array_sort(F.collect_list("seed")).alias("seeds"))
    rest = F.transform(F.slice("seeds", F.lit(2), F.greatest(F.size("seeds"), F.lit(1))), lambda s: s.cast("string"))
    return found.filter("first_seed is not null").select("first_seed", F.array_join(rest, ", ").alias("others"))


def catch_rates(results: DataFrame) -> DataFrame:
    """Per variant and check: seeds run, and seeds on which the check tripped."""
    return results.groupBy("variant", "check_name").agg(F.countDistinct("seed").alias("seeds"), F.countDistinct(F.when(F.col("failed"), F.col("seed"))).alias("caught"))


def meta_reorders(applies: DataFrame, arms: DataFrame) -> DataFrame:
    """Per arm (arm, range_id, first_cut, second_cut or null, since): how long after ``since`` meta first applied the second
    split's update (null: never, or before), and whether it applied one of the first split's after that one.

    ``applies`` (seq, idx, t, range_id, start, stop) has a row a descriptor. An index counts by its first apply, and not
    at all once a higher one was applied. The first split's update is its left half's; the second's is the range
    that ends at the second cut, or the right half from the second cut to the first.
    """
    lines = applies.select("seq", "idx").distinct()
    rising = running(lines, ["seq"], "idx", F.max, F.greatest, True, "highest").filter("highest is null or idx > highest").select("seq", "idx")
    told = applies.join(rising, ["seq", "idx"])
    left = arms.filter("second_cut is not null").select("arm", "range_id", F.col("first_cut").alias("stop"))
    second = arms.select("arm", "range_id", F.col("second_cut").alias("stop"))
    right = arms.select("arm", F.col("second_cut").alias("start"), F.col("first_cut").alias("stop"))
    of_first = told.join(left, ["range_id", "stop"]).groupBy("arm").agg(F.max("idx").alias("last_first"))
    of_second = told.join(second, ["range_id", "stop"]).select("arm", "idx", "t").unionByName(told.join(right, ["start", "stop"]).select("arm", "idx", "t"))
    began = of_second.groupBy("arm").agg(F.min("idx").alias("second_idx"), F.min_by("t", "idx").alias("second_t"))
    met = arms.join(began, "arm", "left").join(of_first, "arm", "left")
    return met.select("arm", F.when(F.col("second_t") >= F.col("since"), F.col("second_t") - F.col("since")).alias("second_applied"), F.coalesce(F.col("last_first") > F.col("second_idx"), F.lit(False)).alias("reordered"))


def refusal_shapes(refusals: DataFrame, splits: DataFrame, load: int, writer: int, reader: int, clients: int) -> DataFrame:
    """One row that counts refusals (seq, range_id, client, place: 'apply', 'read', 'receipt') by shape: writes of the load
    refused at apply, its gets at serving, its stale reads at receipt, and ordinary clients' after a split of the range.

    A client's number above bit 32 tells the load (``load``) or one of ``clients``; its bits ``writer`` and ``reader`` the kind.
    """
    since = splits.groupBy("range_id").agg(F.min("seq").alias("split_seq"))
    told = refusals.join(since, "range_id", "left")
    kind = F.shiftright("client", 32)
    loads, plain = kind == load, F.col("client").bitwiseAND(F.lit(writer | reader)) == 0
    reads = F.col("client").bitwiseAND(F.lit(reader)) != 0
    return told.agg(
        F.count_if(loads & plain & (F.col("place") == "apply")).alias("writes_refused_at_apply"),
        F.count_if(loads & plain & (F.col("place") == "read")).alias("gets_refused_at_serving"),
        F.count_if(loads & reads & (F.col("place") == "receipt")).alias("stale_reads_refused"),
        F.count_if(~loads & kind.between(1, clients) & (F.col("split_seq") < F.col("seq"))).alias("clients_mismatched_by_a_split"),
    )


def splits_from_restarted_nodes(splits: DataFrame, proposals: DataFrame, arms: DataFrame) -> DataFrame:
    """How many splits (range_id, idx, seq) were applied after one of ``arms`` (victim, request) proposed them
    (server, range_id, idx, request, seq) on its restarted node; each counts once."""
    asked = proposals.join(arms.distinct(), (F.col("server") == F.col("victim")) & proposals["request"].eqNullSafe(arms["request"]), "left_semi")
    first = asked.groupBy("range_id", "idx").agg(F.min("seq").alias("proposed"))
    return splits.join(first, ["range_id", "idx"]).filter("seq > proposed").agg(F.countDistinct("range_id", "idx").alias("splits"))


def split_fate(asked: DataFrame, splits: DataFrame, descriptors: DataFrame) -> DataFrame:
    """What became of each split that was asked for (ask, range_id, cut): when it was first applied, and when the range's
    descriptor first left the cut outside or on its bound; null where that never happened.

    ``splits`` have range_id, split_at, t; ``descriptors`` range_id, start, stop, t. Times are those of one clock.
    """
    applied = splits.select("range_id", F.col("split_at").alias("cut"), "t").groupBy("range_id", "cut").agg(F.min("t").alias("applied"))
    cuts = asked.select("range_id", "cut", F.lit(None).cast("long").alias("t")).distinct()

    def first_beyond(bound: str, order: Column) -> DataFrame:
        both = cuts.unionByName(descriptors.groupBy("range_id", F.col(bound).alias("cut")).agg(F.min("t").alias("t")), allowMissingColumns=True)
        reached = Window.partitionBy("range_id").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return both.withColumn("outside", F.min("t").over(reached)).filter("t is null").select("range_id", "cut", "outside")

    # right of the cut begins what starts at it or after, left of it ends what stops at it or before
    beyond = first_beyond("start", F.desc("cut")).unionByName(first_beyond("stop", F.asc("cut")))
    outside = beyond.groupBy("range_id", "cut").agg(F.min("outside").alias("outside"))
    return asked.join(applied, ["range_id", "cut"], "left").join(outside, ["range_id", "cut"], "left").select("ask", "applied", "outside")
