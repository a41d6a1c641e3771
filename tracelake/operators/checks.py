"""Safety checks of replicated logs and ranges, each a query that returns its violations.

Every check reports rows (what it is about, seq of the line where it shows, detail). A check stops at
its first violation in the reference reading; first_violation() takes that row, and verdicts() ranks the
checks. The state of logs at any moment is built once, as intervals of validity (log_view), and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intervals import BUCKET_LINES, as_of, bucket_width, covering, dealt, levels_of, overlapping, point_blocks, running, span_blocks, span_width
from ..functions.scalar import joint_majority

#: Fixed value: the order in which the checks of one trace are judged.
PRECEDENCE = ("descriptor_agreement", "serving_span", "generations_rise", "meta_monotone", "client_refresh", "ids_unique", "split_lineage", "placeholder_votes", "owner_overlap", "tiling")


def first_violation(violations: DataFrame) -> DataFrame:
    """The violation that shows first (least seq), or no row."""
    cols = violations.columns
    return violations.agg(F.min_by(F.struct(*cols), F.struct("seq", *[c for c in cols if c != "seq"])).alias("v")).filter("v is not null").select("v.*")


def verdicts(checks: dict[str, DataFrame]) -> DataFrame:
    """(check_name, violations, first_seq, rank) of every check, in PRECEDENCE first; rank 1 is what a run reports."""
    order = {name: k for k, name in enumerate(PRECEDENCE)}
    parts = [found.agg(F.count(F.lit(1)).alias("violations"), F.min("seq").alias("first_seq")).select(F.lit(name).alias("check_name"), F.lit(order.get(name, len(order))).alias("place"), "violations", "first_seq") for name, found in checks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    rank = F.row_number().over(Window.orderBy(F.col("violations") == 0, "place", "check_name"))  # a row a check
    return out.select("check_name", "violations", "first_seq", rank.cast("long").alias("rank"))


def election_safety(leaders: DataFrame) -> DataFrame:
    """More than one leader in a term of a range."""
    found = leaders.groupBy("range_id", "term").agg(F.countDistinct("server").alias("leaders"), F.min_by("server", "seq").alias("first_server"))
    second = leaders.join(found.filter("leaders > 1"), ["range_id", "term"]).filter("server <> first_server")
    return second.groupBy("range_id", "term").agg(F.first("leaders").alias("leaders"), F.min("seq").alias("seq"))


#: Before any line.
FIRST = -(1 << 63)


def log_view(appends: DataFrame, truncates: DataFrame, installs: DataFrame | None = None, created: DataFrame | None = None) -> DataFrame:
    """Entries with the seq where they end (null: never): at the next append of their index, or the next truncate at
    or below it, install at or above it, or creation of their replica.

    Truncates and installs reach many indices. Entries meet the next cut of their replica by buckets of time, and with it
    how far all cuts from there on reach. Where a cut reaches further than the one before it, some entries end at a later
    one; they look for it by blocks of indices (_first_reaching), so no entry is compared with all cuts of its replica.
    """
    same = F.lead("seq").over(Window.partitionBy("range_id", "server", "idx").orderBy("seq"))
    none = F.lit(None).cast("long")
    entries = appends.select("range_id", "server", "idx", "term", "hash", "seq")
    cuts = truncates.select("range_id", "server", F.col("from_idx").alias("low"), none.alias("high"), none.alias("whole"), F.col("seq").alias("cut"))
    if installs is not None:
        cuts = cuts.unionByName(installs.filter("not taken").select("range_id", "server", none.alias("low"), F.col("last_idx").alias("high"), none.alias("whole"), F.col("seq").alias("cut")))
    if created is not None:
        cuts = cuts.unionByName(created.select("range_id", "server", none.alias("low"), none.alias("high"), F.col("seq").alias("whole"), F.col("seq").alias("cut")))
    by = Window.partitionBy("range_id", "server").orderBy(F.desc("cut"))  # backwards, since Spark folds a frame that only loses rows anew for each
    on = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = cuts.select("range_id", "server", F.coalesce(F.lead("cut").over(by), F.lit(FIRST)).alias("start"), "cut", F.struct("cut", "low", "high", F.min("low").over(on).alias("least"), F.max("high").over(on).alias("most"), F.min("whole").over(on).alias("whole")).alias("next"))
    further = F.coalesce(F.col("next.least") < F.col("next.low"), F.col("next.least").isNotNull()) | F.coalesce(F.col("next.most") > F.col("next.high"), F.col("next.most").isNotNull())
    renewed = F.coalesce(F.col("next.whole") == F.col("next.cut"), F.lit(False))
    deep = not spans.filter(further & ~renewed).isEmpty()
    if deep:  # before the search, which takes rows for the same only if they are in this too
        entries = entries.withColumn("same", same)
    kept = [*entries.columns, "whole"]
    seen = as_of(entries, spans.withColumnRenamed("start", "seq"), ["range_id", "server"], "seq", width=BUCKET_LINES)
    seen = seen.select(*entries.columns, F.when(F.col("seq") < F.col("found.cut"), F.col("found.next")).alias("next")).withColumn("whole", F.col("next.whole"))
    reached = F.coalesce((F.col("next.low") <= F.col("idx")) | (F.col("next.high") >= F.col("idx")), F.lit(False))
    found = seen.select(*kept, F.when(reached, F.col("next.cut")).alias("cut"), "next")
    if deep:
        ever = F.coalesce((F.col("next.least") <= F.col("idx")) | (F.col("next.most") >= F.col("idx")), F.lit(False))
        searched = ever & ~reached & ~renewed
        found = found.filter(~searched).drop("next").unionByName(_first_reaching(seen.filter(searched).select(*kept), cuts))
    else:  # last, so that joins by replica and index need no other shuffle
        found = found.drop("next").withColumn("same", same)
    return found.select("range_id", "server", "idx", "term", "hash", F.col("seq").alias("from_seq"), F.least("same", "cut", "whole").alias("to_seq"))


def _first_reaching(entries: DataFrame, cuts: DataFrame) -> DataFrame:
    """``entries`` with ``cut``, the first of ``cuts`` (low, high, cut) after their seq with low <= idx or high >= idx.

    A cut lies in the aligned block of each level that holds its bound, and the bounds that reach an entry are a
    span of few such blocks; in each of them one window finds the next cut.
    """
    low, top, under, high = cuts.agg(F.min("low"), F.max("low"), F.min("high"), F.max("high")).first()
    payload = F.struct(*entries.columns)
    sides = []
    if low is not None:
        place, stop = F.col("low") - low, F.least("idx", F.lit(top)) - low + 1
        sides.append((0, place, stop, top - low, F.col("idx") >= low))
    if high is not None:
        place, stop = F.lit(high) - F.col("high"), F.lit(high) - F.greatest("idx", F.lit(under)) + 1
        sides.append((1, place, stop, high - under, F.col("idx") <= high))
    if not sides:
        return entries.withColumn("cut", F.lit(None).cast("long"))
    parts = []
    for side, place, stop, span, any_reaches in sides:
        levels, at = levels_of(span + 1), ["range_id", "server", F.lit(side).alias("side")]
        parts.append(cuts.filter(place.isNotNull()).select(*at, F.explode(point_blocks(place, levels)).alias("b"), F.col("cut").alias("seq"), "cut", F.lit(None).cast(entries.select(payload.alias("e")).schema["e"].dataType).alias("e")))
        parts.append(entries.filter(any_reaches).select(*at, F.explode(span_blocks(F.lit(0).cast("long"), stop, levels)).alias("b"), "seq", F.lit(None).cast("long").alias("cut"), payload.alias("e")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    later = Window.partitionBy("range_id", "server", "side", "b.level", "b.block").orderBy(F.desc("seq"), F.col("cut").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.withColumn("after", F.last("cut", ignorenulls=True).over(later)).filter("e is not null")
    return met.groupBy("e").agg(F.min("after").alias("cut")).select("e.*", "cut")


def floors(snapshots: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """(range_id, server, floor, term, from_seq, to_seq): below and at the floor a replica's log is covered.

    A snapshot taken here only raises the floor; an installed one, or a creation, sets it.
    """
    marks = snapshots.select("range_id", "server", F.col("last_idx").alias("at"), "term", "seq", F.col("taken"))
    if created is not None:
        marks = marks.unionByName(created.select("range_id", "server", F.col("idx").alias("at"), "term", "seq", F.lit(False).alias("taken")))
    by = Window.partitionBy("range_id", "server").orderBy("seq")
    epoch = F.sum(F.when(F.col("taken"), 0).otherwise(1)).over(by)
    within = Window.partitionBy("range_id", "server", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.struct("at", "term")).over(within)
    return marks.withColumn("epoch", epoch).withColumn("best", best).select("range_id", "server", F.col("best.at").alias("floor"), F.col("best.term").alias("term"), F.col("seq").alias("from_seq"), F.lead("seq").over(by).alias("to_seq"))


def _alive(interval: DataFrame, seq: Column) -> Column:
    return (interval["from_seq"] <= seq) & (interval["to_seq"].isNull() | (interval["to_seq"] > seq))


def log_matching(entries: DataFrame, floor: DataFrame | None = None) -> DataFrame:
    """Two servers hold an entry of one index and term at the same time with different hashes ('payload'); or equal ones,
    and what they hold before it when the second came differs ('before'): another entry, or one against none.

    ``entries`` is log_view(), ``floor`` floors(): a covered index agrees with anything. Only entries that share
    (range, index, term) meet, one a server, and each pair looks up one index of both.
    """
    cols = ["range_id", "idx", "term"]
    a = entries.select(*cols, F.col("server").alias("a"), F.col("hash").alias("a_hash"), F.col("from_seq").alias("a_from"), F.col("to_seq").alias("a_to"))
    b = entries.select(*cols, F.col("server").alias("b"), F.col("hash").alias("b_hash"), F.col("from_seq").alias("b_from"), F.col("to_seq").alias("b_to"))
    met = a.join(b, cols).filter("a < b and (a_to is null or a_to > b_from) and (b_to is null or b_to > a_from)")
    met = met.select(*cols, "a", "b", (F.col("a_hash") == F.col("b_hash")).alias("same"), F.greatest("a_from", "b_from").alias("seq"))
    payload = met.filter("not same").select(*cols, "a", "b", F.lit("payload").alias("what"), "seq")
    below = met.filter("same").withColumn("at", F.col("idx") - 1)
    for side in ("a", "b"):
        held = entries.select(F.col("range_id").alias("h_range"), F.col("server").alias("h_server"), F.col("idx").alias("h_idx"), F.struct("term", "hash").alias(f"{side}_held"), "from_seq", "to_seq")
        on = (F.col("range_id") == F.col("h_range")) & (F.col(side) == F.col("h_server")) & (F.col("at") == F.col("h_idx")) & (F.col("from_seq") <= F.col("seq")) & (F.col("to_seq").isNull() | (F.col("to_seq") > F.col("seq")))
        below = below.join(held, on, "left").drop("h_range", "h_server", "h_idx", "from_seq", "to_seq")
        if floor is not None:
            over = floor.select(F.col("range_id").alias("f_range"), F.col("server").alias("f_server"), "floor", "from_seq", "to_seq")
            reach = (F.col("range_id") == F.col("f_range")) & (F.col(side) == F.col("f_server")) & (F.col("floor") >= F.col("at")) & (F.col("from_seq") <= F.col("seq")) & (F.col("to_seq").isNull() | (F.col("to_seq") > F.col("seq")))
            below = below.join(over, reach, "left_anti")
    return payload.unionByName(below.filter("not (a_held <=> b_held)").select(*cols, "a", "b", F.lit("before").alias("what"), "seq"))


def leader_completeness(commits: DataFrame, leaders: DataFrame, entries: DataFrame, floor: DataFrame | None = None) -> DataFrame:
    """A leader whose log lacks an entry committed in an earlier term before it was elected.

    For each server that ever led and each committed entry, the times after the commit when the server doesn't
    hold it are found first, from one window over its entries of that index. They meet the server's elections by
    blocks of time (span_blocks); in each block one window in order of terms finds the least index that an election's log lacks.
    With ``floor`` each pair of a lack and an election is looked at, since floors forgive some.
    """
    committed = commits.groupBy("range_id", "idx").agg(F.min_by("entry_term", "seq").alias("term"), F.min("term").alias("in_term"), F.min("seq").alias("at"))
    led = leaders.select("range_id", "server", F.col("term").alias("led"), F.col("seq").alias("elected"))
    key = ["range_id", "server", "idx", "term"]
    owed = committed.join(led.select("range_id", "server").distinct(), "range_id")
    held = entries.select(*key, "from_seq", "to_seq").join(committed.select("range_id", "idx", "term", "in_term", "at"), ["range_id", "idx", "term"])
    marks = owed.select(*key, "in_term", "at", F.col("at").alias("from_seq"), F.col("at").alias("to_seq"))  # nothing is held until the commit, as far as this goes
    marks = marks.unionByName(held.filter("to_seq is null or to_seq > at").select(*key, "in_term", "at", F.greatest("from_seq", "at").alias("from_seq"), "to_seq"))
    by = Window.partitionBy(*key).orderBy("from_seq", F.col("to_seq").asc_nulls_last())
    upto = F.max(F.coalesce("to_seq", F.lit(1 << 62))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lacks = marks.withColumn("lost", upto).withColumn("again", F.coalesce(F.lead("from_seq").over(by), F.lit(1 << 62))).filter("lost < again")
    lacks = lacks.select(F.col("range_id").alias("l_range"), F.col("server").alias("l_server"), "idx", F.col("term"), "in_term", "at", "lost", "again")
    if floor is None:
        return _least_lacking(led, lacks)
    on = (led["range_id"] == F.col("l_range")) & (led["server"] == F.col("l_server")) & (F.col("elected") > F.col("at")) & (F.col("elected") >= F.col("lost")) & (F.col("elected") < F.col("again")) & (F.col("in_term") < F.col("led"))
    missing = led.join(lacks, on)
    missing = missing.join(floor, (missing["range_id"] == floor["range_id"]) & (missing["server"] == floor["server"]) & (floor["floor"] >= missing["idx"]) & _alive(floor, missing["elected"]), "left_anti")
    return missing.groupBy("range_id", "led", "server").agg(F.min("idx").alias("idx"), F.min("elected").alias("seq"))


def _least_lacking(led: DataFrame, lacks: DataFrame) -> DataFrame:
    """Per (range, led, server) the least index lacked at any of its elections, and the first election that lacks one."""
    first, last = led.agg(F.min("elected"), F.max("elected")).first()
    first, last = (0, -1) if first is None else (first, last)
    levels = levels_of(last - first + 1)
    start, stop = F.greatest("lost", F.col("at") + 1, F.lit(first)) - first, F.least("again", F.lit(last + 1)) - first
    spans = lacks.withColumn("start", start).withColumn("stop", stop).filter("start < stop and in_term is not null")
    a = spans.select(F.col("l_range").alias("range_id"), F.col("l_server").alias("server"), F.explode(span_blocks(F.col("start"), F.col("stop"), levels)).alias("b"), F.col("in_term").alias("term"), F.col("idx"), F.lit(None).cast("long").alias("elected"))
    b = led.select("range_id", "server", F.explode(point_blocks(F.col("elected") - first, levels)).alias("b"), F.col("led").alias("term"), F.lit(None).cast("long").alias("idx"), "elected")
    below = Window.partitionBy("range_id", "server", "b.level", "b.block").orderBy("term", F.col("elected").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = a.unionByName(b).withColumn("least", F.min("idx").over(below)).filter("elected is not null and least is not null")
    return met.groupBy("range_id", F.col("term").alias("led"), "server").agg(F.min("least").alias("idx"), F.min("elected").alias("seq"))


def commit_majority(commits: DataFrame, entries: DataFrame, configs: DataFrame, floor: DataFrame | None = None) -> DataFrame:
    """A commit of an index that no majority of the voters (old, and new if joint) holds at that moment.

    ``commits``: a row per committed index, with the entry's term; ``configs``: range_id, seq, voters, joining.
    """
    placed = as_of(commits.select("range_id", "server", "idx", "term", "seq"), configs.select("range_id", "seq", "voters", "joining"), ["range_id"], "seq", width=BUCKET_LINES)
    c = placed.select("range_id", "server", "idx", "term", "seq", F.col("found.voters").alias("voters"), F.col("found.joining").alias("joining"))
    e = entries.select(F.col("range_id").alias("e_range"), F.col("server").alias("holder"), F.col("idx").alias("e_idx"), F.col("term").alias("e_term"), "from_seq", "to_seq")
    held = c.join(e, (c["range_id"] == e["e_range"]) & (c["idx"] == e["e_idx"]) & (c["term"] == e["e_term"]) & _alive(e, c["seq"]), "left")
    keys = ["range_id", "server", "idx", "term", "seq"]
    held = held.groupBy(*keys).agg(F.first("voters").alias("voters"), F.first("joining").alias("joining"), F.collect_set("holder").alias("holders"))
    if floor is not None:
        f = floor.select(F.col("range_id").alias("f_range"), F.col("server").alias("covered"), "floor", F.col("from_seq").alias("f_from"), F.col("to_seq").alias("f_to"))
        over = held.join(f, (held["range_id"] == f["f_range"]) & (f["floor"] >= held["idx"]) & (f["f_from"] <= held["seq"]) & (f["f_to"].isNull() | (f["f_to"] > held["seq"])), "left")
        held = over.groupBy(*keys).agg(F.first("voters").alias("voters"), F.first("joining").alias("joining"), F.array_union(F.first("holders"), F.collect_set("covered")).alias("holders"))
    return held.filter(~F.coalesce(joint_majority(F.col("holders"), F.col("voters"), F.col("joining")), F.lit(False))).select("range_id", "server", "idx", F.size("holders").cast("long").alias("holders"), "seq")


def commit_current_term(commits: DataFrame, entries: DataFrame) -> DataFrame:
    """A leader's commit (with its own term) that lands on an entry of another term."""
    c, e = commits.alias("c"), entries.alias("e")
    on = (F.col("c.range_id") == F.col("e.range_id")) & (F.col("c.server") == F.col("e.server")) & (F.col("c.idx") == F.col("e.idx")) & (F.col("e.from_seq") <= F.col("c.seq")) & (F.col("e.to_seq").isNull() | (F.col("e.to_seq") > F.col("c.seq")))
    return c.join(e, on).filter(F.col("c.term") != F.col("e.term")).select("c.range_id", "c.server", "c.idx", F.col("c.term").alias("led"), F.col("e.term").alias("term"), "c.seq")


def committed_not_truncated(commits: DataFrame, truncates: DataFrame, resets: DataFrame) -> DataFrame:
    """A truncate at or below what its server had committed; a reset (refusal, removal) forgets."""
    rows = commits.select("range_id", "server", "seq", "idx", F.lit(None).cast("long").alias("from_idx"), F.lit(0).alias("reset"))
    rows = rows.unionByName(truncates.select("range_id", "server", "seq", F.lit(None).cast("long").alias("idx"), "from_idx", F.lit(0).alias("reset")))
    rows = rows.unionByName(resets.select("range_id", "server", "seq", F.lit(None).cast("long").alias("idx"), F.lit(None).cast("long").alias("from_idx"), F.lit(1).alias("reset")))
    by = Window.partitionBy("range_id", "server").orderBy("seq", "reset", F.col("from_idx").isNotNull())
    epoch = F.sum("reset").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = F.max("idx").over(Window.partitionBy("range_id", "server", "epoch").orderBy("seq", F.col("from_idx").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("epoch", epoch).withColumn("committed", held).filter("from_idx is not null and from_idx <= committed").select("range_id", "server", "from_idx", "committed", "seq")


def state_machine_safety(applies: DataFrame) -> DataFrame:
    """An index of a range applied as two different entries, or with two different known effects (an unknown one agrees)."""
    found = applies.groupBy("range_id", "idx").agg(F.countDistinct(F.struct("term", "hash")).alias("entries"), F.countDistinct("effect").alias("effects"), F.min("seq").alias("seq"))
    return found.filter("entries > 1 or effects > 1").select("range_id", "idx", "entries", "effects", "seq")


def apply_order(applies: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Applies of a replica that don't follow the one before by one; a start (range_id, server, floor, seq) sets the floor."""
    rows = applies.select("range_id", "server", "seq", "idx", F.lit(False).alias("start"))
    if starts is not None:
        rows = rows.unionByName(starts.select("range_id", "server", "seq", F.col("floor").alias("idx"), F.lit(True).alias("start")))
    before = F.lag("idx").over(Window.partitionBy("range_id", "server").orderBy("seq", F.desc("start")))
    return rows.withColumn("before", before).filter("not start and before is not null and idx <> before + 1").select("range_id", "server", "before", "idx", "seq")


def descriptor_agreement(values: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """An (range, index) with two descriptor values; or a restatement that isn't the latest value at or below its index."""
    value = F.struct("start", "stop", "generation", "state")
    apart = values.groupBy("range_id", "idx").agg(F.countDistinct(value).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("seq")).filter("n > 1").select("range_id", "idx", F.lit("two values").alias("what"), "seq")
    if statements is None:
        return apart
    agreed = values.groupBy("range_id", "idx").agg(F.min_by(value, "seq").alias("value"))
    found = as_of(statements.select("range_id", "idx", "seq", value.alias("said")), agreed, ["range_id"], "idx")
    return apart.unionByName(found.filter(F.col("found.value").isNull() | (F.col("said") != F.col("found.value"))).select("range_id", "idx", F.lit("restated otherwise").alias("what"), "seq"))


def serving_span(served: DataFrame, values: DataFrame) -> DataFrame:
    """Applied commands whose key isn't in the descriptor in force before their index, ones refused although it is, and
    ones without any descriptor."""
    agreed = values.groupBy("range_id", "idx").agg(F.min_by(F.struct("start", "stop", "state"), "seq").alias("v"))
    found = as_of(served.select("range_id", "idx", "key", "effect", "seq"), agreed, ["range_id"], "idx", inclusive=False).withColumn("v", F.col("found.v"))
    inside = (F.col("key") >= F.col("v.start")) & (F.col("key") < F.col("v.stop")) & (F.col("v.state") != "subsumed")
    what = F.when(F.col("v").isNull(), "no descriptor").when((F.col("effect") == "applied") & ~inside, "served outside").when((F.col("effect") == "out_of_span") & inside, "refused inside")
    return found.withColumn("what", what).filter("what is not null").select("range_id", "idx", "what", "seq")


def generations_rise(writes: DataFrame) -> DataFrame:
    """Per key, over the first applied write of each (range, index): a generation that falls, or another range's that doesn't rise."""
    firsts = writes.groupBy("range_id", "idx").agg(F.min_by(F.struct("key", "generation", "seq"), "seq").alias("w")).select("range_id", "w.key", "w.generation", "w.seq")
    by = Window.partitionBy("key").orderBy("seq")
    marked = firsts.withColumn("last_generation", F.lag("generation").over(by)).withColumn("last_range", F.lag("range_id").over(by))
    bad = (F.col("generation") < F.col("last_generation")) | ((F.col("range_id") != F.col("last_range")) & (F.col("generation") <= F.col("last_generation")))
    return marked.filter(bad).select("key", "last_range", "range_id", "last_generation", "generation", "seq")


def meta_monotone(won: DataFrame) -> DataFrame:
    """Elementary key intervals whose generation falls from one meta index to a later one that won them.

    ``won`` has the spans that each update won (idx, range_id, start, stop, generation, seq): a stale update that
    won nothing names nothing, and is no violation. Order is that of idx, whatever order replicas applied in.
    """
    from .ranges import elementary

    spans = won.select("start", "stop", "idx", "range_id", "generation", "seq")
    named = covering(elementary(won), spans, "low", "start", "stop").select("low", "high", "idx", "range_id", "generation", "seq")
    before = F.max("generation").over(Window.partitionBy("low").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1))
    return named.withColumn("before", before).filter("generation < before").select("low", "high", "idx", "range_id", "before", "generation", "seq")


def meta_named(updates: DataFrame, known: DataFrame) -> DataFrame:
    """Updates that name a range at a generation not traced before them ('unknown'), or with another span than the first
    traced at that generation ('differs'). ``known``: range_id, generation, start, stop, seq."""
    first = known.groupBy("range_id", "generation").agg(F.min_by(F.struct("start", "stop", "seq"), "seq").alias("k"))
    met = updates.join(first, ["range_id", "generation"], "left")
    what = F.when(F.col("k").isNull() | (F.col("k.seq") > F.col("seq")), "unknown").when((F.col("k.start") != F.col("start")) | (F.col("k.stop") != F.col("stop")), "differs")
    return met.withColumn("what", what).filter("what is not null").select("idx", "range_id", "generation", "what", "seq")


def client_refresh(sends: DataFrame, mismatches: DataFrame) -> DataFrame:
    """Sends to an older generation than a mismatch before them, of the same client and operation, named for the key."""
    s = sends.select("client", "invoked", "key", F.col("generation").alias("sent"), "seq")
    m = mismatches.select("client", "invoked", "generation", "start", "stop", F.col("seq").alias("told"))
    due = s.join(m, ["client", "invoked"]).filter("told < seq and key >= start and key < stop")
    return due.groupBy("client", "invoked", "key", "sent", "seq").agg(F.max("generation").alias("named")).filter("sent < named")


def ids_unique(grants: DataFrame) -> DataFrame:
    """Id blocks that are empty, overlap an earlier block, or that another replica applied otherwise at the same index."""
    firsts = grants.groupBy("idx").agg(F.min_by(F.struct("first_id", "last_id", "seq"), "seq").alias("g")).select("idx", "g.first_id", "g.last_id", "g.seq")
    empty = firsts.filter("first_id > last_id").select("idx", F.lit("empty").alias("what"), "seq")
    reached = running(firsts, ["first_id", "idx"], "last_id", F.max, F.greatest, before=True, name="reach")
    overlap = reached.filter("first_id <= reach").select("idx", F.lit("overlap").alias("what"), "seq")
    other = grants.alias("g").join(firsts.alias("f"), "idx").filter("g.first_id <> f.first_id or g.last_id <> f.last_id").groupBy("idx").agg(F.min("g.seq").alias("seq")).select("idx", F.lit("replicas differ").alias("what"), "seq")
    return empty.unionByName(overlap).unionByName(other)


def split_lineage(split: DataFrame, values: DataFrame, grants: DataFrame) -> DataFrame:
    """Splits whose halves don't follow from the descriptor in force: spans, generation, and a right id from a granted block.

    ``split``: idx, range_id, split_at, right_id, left/right start, stop and generation, node, seq.
    """
    agreed = values.groupBy("range_id", "idx").agg(F.min_by(F.struct("start", "stop", "generation"), "seq").alias("v"))
    placed = as_of(split, agreed, ["range_id"], "idx", inclusive=False)
    v = F.col("found.v")
    good = (F.col("left_start") == v["start"]) & (F.col("left_stop") == F.col("split_at")) & (F.col("right_start") == F.col("split_at")) & (F.col("right_stop") == v["stop"])
    rise = (F.col("left_generation") == v["generation"] + 1) & (F.col("right_generation") == v["generation"] + 1)
    firsts = grants.groupBy("idx").agg(F.min_by(F.struct("node", "first_id", "last_id"), "seq").alias("g")).select(F.col("g.first_id").alias("right_id"), F.col("g.last_id").alias("last_id"), F.col("g.node").alias("holder"), F.lit(0).alias("one"))
    owned = as_of(placed.withColumn("one", F.lit(0)), firsts, ["one"], "right_id", value="block")
    held = (F.col("block.last_id") >= F.col("right_id")) & (F.col("block.holder") == F.col("node"))
    again = F.row_number().over(Window.partitionBy("right_id").orderBy("seq")) > 1
    what = F.when(v.isNull(), "no descriptor").when(~good, "spans").when(~rise, "generation").when(~F.coalesce(held, F.lit(False)), "id not granted").when(F.col("again"), "id used again")
    return owned.withColumn("again", again).withColumn("what", what).filter("what is not null").select("range_id", "idx", "what", "seq")


def placeholder_votes(votes: DataFrame, states: DataFrame) -> DataFrame:
    """Granted votes of a range on a node that has nothing created or restated since its last removal or refusal."""
    last = as_of(votes.filter("granted").select("range_id", "node", "term", "seq"), states.select("range_id", "node", "what", "seq"), ["range_id", "node"], "seq", inclusive=False)
    return last.filter("found is null or found.what in ('removed', 'refused')").select("range_id", "node", "term", "seq")


def _held_then(events: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of an event (node, range_id, start, stop, seq) and a span that another range of its node holds at that moment
    and that overlaps it. ``held``: node, range_id, start, stop, from_seq, to_seq.

    Both are dealt to buckets of keys, and holdings to buckets of time, so that an event meets what is held
    about its keys and its time, not all that ever was.
    """
    last = events.agg(F.max("seq")).first()[0] or 0
    h = held.select("node", F.col("range_id").alias("holder"), F.col("start").alias("h_start"), F.col("stop").alias("h_stop"), (F.col("from_seq") + 1).alias("h_from"), F.least(F.coalesce("to_seq", F.lit(last + 1)), F.lit(last + 1)).alias("h_until"))
    width = span_width((h, "h_from", "h_until"))
    h = dealt(h, "h_from", "h_until", width, "epoch")
    e = events.withColumn("epoch", F.floor(F.col("seq") / width))
    met = overlapping(e, h, ("start", "stop"), ("h_start", "h_stop"), ["node", "epoch"])
    return met.filter((F.col("holder") != F.col("range_id")) & (F.col("h_from") <= F.col("seq")) & (F.col("h_until") > F.col("seq")))


def owner_overlap(held: DataFrame) -> DataFrame:
    """Two ranges of one node whose spans overlap at the same time: ``held`` has node, range_id, start, stop, from_seq, to_seq."""
    met = _held_then(held.select("node", "range_id", "start", "stop", F.col("from_seq").alias("seq")), held)
    return met.groupBy("node", "range_id", "seq").agg(F.min(F.greatest("start", "h_start")).alias("low")).select("node", "range_id", "low", "seq")


def tiling(spans: DataFrame, low: int, high: int) -> DataFrame:
    """Gaps and overlaps of the ranges' latest spans over the keyspace [low, high)."""
    ends = spans.agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    outside = ends.select(F.explode(F.array(F.when(F.col("first") > low, F.struct(F.lit("gap").alias("kind"), F.lit(low).cast("long").alias("from_key"), F.col("first").alias("until_key"))), F.when(F.col("last") < high, F.struct(F.lit("gap").alias("kind"), F.col("last").alias("from_key"), F.lit(high).cast("long").alias("until_key"))))).alias("g")).filter("g is not null").select("g.*")
    from ..functions.intervals import gaps_and_overlaps

    return gaps_and_overlaps(spans, []).unionByName(outside)


def tiling_after(held: DataFrame, commands: DataFrame, low: int, high: int) -> DataFrame:
    """Commands (range_id, seq) after which part of the keyspace [low, high) lies in no range's latest span, and where it
    begins. ``held``: range_id, start, stop, from_seq, to_seq.

    For each elementary interval the times when nothing holds it are found in one window over the spans that
    cover it; commands meet these times, few on a good run, in buckets.
    """
    from .ranges import elementary

    ends = held.sparkSession.createDataFrame([(low, high)], "start long, stop long")
    cut = elementary(held.select("start", "stop").unionByName(ends)).filter((F.col("low") >= low) & (F.col("high") <= high)).select("low")
    last = commands.agg(F.max("seq")).first()[0] or 0
    spans = covering(cut, held.select("start", "stop", "from_seq", "to_seq"), "low", "start", "stop").select("low", "from_seq", F.coalesce("to_seq", F.lit(last + 1)).alias("to_seq"))
    first = commands.agg(F.min("seq")).first()[0] or 0
    marks = spans.unionByName(cut.select("low", F.lit(first).cast("long").alias("from_seq"), F.lit(first).cast("long").alias("to_seq")))
    by = Window.partitionBy("low").orderBy("from_seq", "to_seq")
    upto = F.max("to_seq").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bare = marks.withColumn("bare_from", F.greatest(upto, F.lit(first))).withColumn("bare_until", F.coalesce(F.lead("from_seq").over(by), F.lit(last + 1))).filter("bare_from < bare_until").select("low", "bare_from", "bare_until")
    return covering(commands.select("range_id", "seq"), bare, "seq", "bare_from", "bare_until").groupBy("range_id", "seq").agg(F.min("low").alias("low"))


def created_twice(events: DataFrame) -> DataFrame:
    """A range created on a node that holds it already: ``events`` has range_id, node, what, seq."""
    before = F.lag("what").over(Window.partitionBy("range_id", "node").orderBy("seq"))
    return events.withColumn("before", before).filter("what = 'created' and before = 'created'").select("range_id", "node", "seq")


def right_half_owed(splits: DataFrame, events: DataFrame) -> DataFrame:
    """Splits applied on a node (node, right_id, seq) whose right half that node never created, before or after."""
    made = events.filter("what = 'created'").select(F.col("range_id").alias("right_id"), "node").distinct()
    return splits.join(made, ["right_id", "node"], "left_anti").select("node", "right_id", "seq")


def install_over_another(installs: DataFrame, held: DataFrame) -> DataFrame:
    """Installs (node, range_id, start, stop, seq) over a span that another range of the node holds at that moment."""
    return _held_then(installs, held).groupBy("node", "range_id", "seq").agg(F.min("holder").alias("holder"))


def recovery_losses(writes: DataFrame, recovered: DataFrame, faults: DataFrame) -> DataFrame:
    """Durable writes (epoch, seq, t) that a recovery (epoch, seq) lost without a traced fault (from_t, until_t) at that time."""
    gone = writes.join(recovered, ["epoch", "seq"], "left_anti")
    spans = faults.select("from_t", (F.col("until_t") + 1).alias("after_t"))
    told = covering(gone.select("epoch", "seq", "t"), spans, "t", "from_t", "after_t").select("epoch", "seq").distinct()
    return gone.join(told, ["epoch", "seq"], "left_anti").select("epoch", "seq")


def table_of_writes(writes: DataFrame, flushes: DataFrame, compactions: DataFrame) -> DataFrame:
    """The table that holds each write (seq) now: its flush's (number, first_seq, max_seq), followed through compactions
    (input, output). Tables are few beside writes: their last successors are found first, then flushes join by seq."""
    spark = writes.sparkSession
    last = spark.sql(
        """WITH RECURSIVE walk(number, now, depth) AS (
               SELECT number, number, 0 FROM {flushes}
               UNION ALL SELECT w.number, c.output, w.depth + 1 FROM walk w JOIN {compactions} c ON c.input = w.now)
           SELECT number, max_by(now, depth) AS table_number FROM walk GROUP BY number""",
        flushes=flushes.select("number"), compactions=compactions,
    )
    placed = as_of(writes.withColumn("one", F.lit(0)), flushes.select(F.lit(0).alias("one"), F.col("first_seq").alias("seq"), "number", "max_seq"), ["one"], "seq", value="flush", width=bucket_width(flushes, "first_seq", "max_seq"))
    return placed.filter(F.col("flush.max_seq") >= F.col("seq")).select("seq", F.col("flush.number").alias("number")).join(last, "number").select("seq", "table_number")
