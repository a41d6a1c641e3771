"""As-of and interval joins as unions and windows: one shuffle by key, no comparison of all pairs."""

from __future__ import annotations

import math
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, inclusive: bool = True, value: str = "found", width: int | None = None) -> DataFrame:
    """``left`` with a struct of the latest row of ``right`` per ``keys`` whose ``on`` is at (inclusive) or before its own.

    Both sides go through one window: rows of both sorted by key and place, the last right row carried on.
    Ties on the right go to its greatest other columns. With ``width`` (for longs) a key's rows are split into
    buckets of that width, and each bucket begins with the last right row before it: no key is one task then.
    """
    kept = F.struct(F.col(on), *[F.col(c) for c in right.columns if c not in (*keys, on)])
    kind = right.select(kept.alias("r")).schema["r"].dataType
    bucket = F.floor(F.col(on) / width).cast("long") if width else F.lit(0).cast("long")
    a = left.select(*keys, bucket.alias("bucket"), F.col(on).alias("place"), F.lit(2 if inclusive else 0).alias("turn"), F.struct(*[F.col(c) for c in left.columns]).alias("row"), F.lit(None).cast(kind).alias("r"))
    row = a.schema["row"].dataType
    b = right.select(*keys, bucket.alias("bucket"), F.col(on).alias("place"), F.lit(1).alias("turn"), F.lit(None).cast(row).alias("row"), kept.alias("r"))
    both = a.unionByName(b)
    if width:
        # one row a key and bucket: the last right row of the buckets before
        last = b.groupBy(*keys, "bucket").agg(F.max(F.struct("place", "r")).alias("last")).unionByName(a.select(*keys, "bucket").distinct().withColumn("last", F.lit(None).cast(b.select(F.struct("place", "r").alias("l")).schema["l"].dataType)))
        last = last.groupBy(*keys, "bucket").agg(F.max("last").alias("last"))
        before = F.last("last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        both = both.unionByName(last.withColumn("last", before).filter("last is not null").select(*keys, "bucket", "last.place", F.lit(-1).alias("turn"), F.lit(None).cast(row).alias("row"), "last.r"))
    w = Window.partitionBy(*keys, "bucket").orderBy("place", "turn", "r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("r", ignorenulls=True).over(w)).filter("row is not null").select("row.*", value)


def bucket_width(rows: DataFrame, low: str, high: str, buckets: int = 1024) -> int:
    """A width that cuts the span of two long columns into so many buckets."""
    ends = rows.agg(F.min(low).alias("low"), F.max(high).alias("high")).first()
    return 1 if ends.low is None else max(1, -(-(ends.high - ends.low) // buckets))


#: Lines of a trace that a task takes at a time where a key's rows are dealt to buckets of places.
BUCKET_LINES = 1 << 16


def numbered(rows: DataFrame, keys: list[str], on: str, name: str, width: int = BUCKET_LINES) -> DataFrame:
    """``rows`` with their number in each of ``keys`` in order of ``on`` (a long, nulls first), from 1: row_number(), but a key's
    rows are split into buckets of that width, and each bucket begins with how many rows there are before it."""
    cut = rows.withColumn("_bucket", F.floor(F.col(on) / width).cast("long"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row a bucket
    heads = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.coalesce(before, F.lit(0).cast("long")))
    both = cut.withColumn("_n", F.lit(1).cast("long")).withColumn("_turn", F.lit(1)).unionByName(heads.withColumn("_turn", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "_bucket").orderBy("_turn", on).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.sum("_n").over(upto)).filter("_turn = 1").drop("_bucket", "_n", "_turn")


def with_next(rows: DataFrame, keys: list[str], on: str, tie: str, width: int, name: str) -> DataFrame:
    """``rows`` with the ``on`` of the next row of its keys, in buckets of ``width``: a bucket's last row takes the first
    of the next bucket that has any, from a table of one row a bucket."""
    cut = rows.withColumn("bucket", F.floor(F.col(on) / width).cast("long"))
    firsts = cut.groupBy(*keys, "bucket").agg(F.min(on).alias("first"))
    after = firsts.withColumn("__after", F.lead("first").over(Window.partitionBy(*keys).orderBy("bucket"))).drop("first")
    inside = cut.withColumn("__inside", F.lead(on).over(Window.partitionBy(*keys, "bucket").orderBy(on, tie)))
    return inside.join(after, [*keys, "bucket"]).withColumn(name, F.coalesce("__inside", "__after")).drop("bucket", "__inside", "__after")


def span_width(*spans: tuple[DataFrame, str, str]) -> int:
    """The mean length of several lists of spans: dealt to buckets of it, they make some two rows each."""
    lengths = None
    for rows, start, stop in spans:
        own = rows.select((F.col(stop) - F.col(start)).alias("length")).filter("length > 0")
        lengths = own if lengths is None else lengths.unionByName(own)
    mean = lengths.agg(F.avg("length")).first()[0]
    return max(1, -int(-(mean or 1) // 1))


def dealt(spans: DataFrame, start: str, stop: str, width: int, name: str) -> DataFrame:
    """``spans`` (of longs, the empty ones gone) once for every bucket of ``width`` that they meet."""
    return spans.filter(F.col(start) < F.col(stop)).withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))))


def covering(points: DataFrame, spans: DataFrame, on: str, start: str, stop: str, by: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Every pair of a point and a span with start <= on < stop, joined by equality of ``by`` and bucket."""
    width = width or span_width((spans, start, stop))
    met = points.withColumn("_bucket", F.floor(F.col(on) / width)).join(dealt(spans, start, stop, width, "_bucket"), [*(by or []), "_bucket"])
    return met.filter((F.col(on) >= F.col(start)) & (F.col(on) < F.col(stop))).drop("_bucket")


def overlapping(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], by: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Every pair of overlapping spans of ``a`` and ``b``, once: in the bucket where their common part begins."""
    width = width or span_width((a, *a_span), (b, *b_span))
    met = dealt(a, *a_span, width, "_bucket").join(dealt(b, *b_span, width, "_bucket"), [*(by or []), "_bucket"])
    low, high = F.greatest(a_span[0], b_span[0]), F.least(a_span[1], b_span[1])
    return met.filter((low < high) & (F.col("_bucket") == F.floor(low / width))).drop("_bucket")


def levels_of(span: int) -> int:
    """Levels of aligned blocks (of 2**level each) that places 0 to ``span`` need: one block of the last holds them all."""
    return max(0, span).bit_length()


def point_blocks(place: Column, levels: int) -> Column:
    """The aligned block of every level that holds a place: an array of (level, block)."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", place.cast("long"), k).alias("block")))


def span_blocks(start: Column, stop: Column, levels: int) -> Column:
    """The fewest aligned blocks, two a level at most, that make up [start, stop): an array of (level, block).

    A place and a span that holds it share exactly one block of point_blocks and span_blocks, so they meet by equality.
    """

    def two(k: Column) -> Column:
        low, high = -F.call_function("shiftright", -start.cast("long"), k), F.call_function("shiftright", stop.cast("long"), k)  # rounded up and down
        first = F.when((low < high) & (low.bitwiseAND(F.lit(1)) == 1), low)
        last = F.when((low < high) & (high.bitwiseAND(F.lit(1)) == 1), high - 1)
        return F.array(F.struct(k.alias("level"), first.alias("block")), F.struct(k.alias("level"), last.alias("block")))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), two)), lambda b: b["block"].isNotNull())


#: Bytes of a key, after what all of them begin with, that place it on a line.
PLACE_BYTES = 6


def in_spans(rows: DataFrame, spans: DataFrame, how: str, key: str = "key", start: str = "start", stop: str = "stop", only: Column | None = None) -> DataFrame:
    """``rows`` whose text or binary key lies in a span, start <= key < stop (``how`` 'left_semi'), or in none ('left_anti').

    Keys are placed on a line by the first bytes after those that all spans' bounds share, an order that ties but never
    turns; spans are dealt to buckets of their mean length there, and rows meet them by equality, then exactly.
    ``only``: a condition on rows that a match must meet as well. Rows beyond all spans are spread by a hash.
    """
    own = spans.select(F.col(start).alias("_start"), F.col(stop).alias("_stop")).filter("_start < _stop").distinct()
    first, last = own.agg(F.min("_start"), F.max("_stop")).first()
    if first is None:
        return rows if how == "left_anti" else rows.filter(F.lit(False))
    first, last = (b if isinstance(b, str) else bytes(b) for b in (first, last))
    same = len(os.path.commonprefix([b.encode() if isinstance(b, str) else b for b in (first, last)]))

    def place(c: Column) -> Column:
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), same + 1, PLACE_BYTES)), 2 * PLACE_BYTES, "0"), 16, 10).cast("long")

    sized = own.withColumn("_lo", place(F.col("_start"))).withColumn("_hi", place(F.col("_stop")))
    width = max(1, math.ceil(sized.agg(F.avg(F.col("_hi") - F.col("_lo") + 1)).first()[0]))
    buckets = sized.select("_start", "_stop", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))).alias("_bucket"))
    k = F.col(key)
    beyond = -1 - F.pmod(F.xxhash64(k), F.lit(1 << 20))
    placed = rows.withColumn("_at", F.when((k >= F.lit(first)) & (k < F.lit(last)), F.floor(place(k) / width)).otherwise(beyond))
    match = (F.col("_at") == F.col("_bucket")) & (placed[key] >= F.col("_start")) & (placed[key] < F.col("_stop"))
    return placed.join(buckets, match if only is None else match & only, how).drop("_at")


def valid_until(rows: DataFrame, keys: list[str], on: str, name: str = "until") -> DataFrame:
    """``rows`` with the ``on`` of the next row of its key: each holds from its own until there (null: for ever)."""
    return rows.withColumn(name, F.lead(on).over(Window.partitionBy(*keys).orderBy(on)))


def gaps_and_overlaps(spans: DataFrame, by: list[str], order: Column | str = "start") -> DataFrame:
    """Where a span doesn't begin at the furthest end before it: kind 'gap' or 'overlap', from and until."""
    before = F.max("stop").over(Window.partitionBy(*by).orderBy(order, "stop").rowsBetween(Window.unboundedPreceding, -1))
    found = spans.withColumn("reach", before).withColumn("kind", F.when(F.col("reach") < F.col("start"), "gap").when(F.col("reach") > F.col("start"), "overlap"))
    least = F.least("reach", "start")
    most = F.when(F.col("kind") == "gap", F.col("start")).otherwise(F.least("reach", "stop"))
    return found.filter("kind is not null").select(*by, "kind", least.alias("from_key"), most.alias("until_key"))


#: Rows of one counter that a task takes at a time, on average.
RUN_ROWS = 10_000


def running(df: DataFrame, order: list[str], value: str, fold: Callable[[str], Column], join: Callable[[Column, Column], Column], before: bool, name: str, rows: int = RUN_ROWS) -> DataFrame:
    """``df`` with the running ``fold`` (F.sum, F.max) of ``value`` in ``order``, over the rows up to each or only those before it.

    The first column of ``order`` is a number: its range is cut evenly, each part has its own window, and what
    the parts before it come to is joined as an offset (``join`` of offset and own), so no task takes all rows.
    """
    x = F.col(order[0]).cast("double")
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.ceil(F.count(F.lit(1)) / rows).alias("_parts"))
    width = (F.col("_hi") - F.col("_lo") + 1) / F.col("_parts")
    dealt = df.crossJoin(F.broadcast(ends)).withColumn("_part", F.coalesce(F.floor((x - F.col("_lo")) / width), F.lit(-1))).drop("_lo", "_hi", "_parts")  # one row
    own = Window.partitionBy("_part").orderBy(*order)
    own = own.rowsBetween(Window.unboundedPreceding, -1) if before else own.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = dealt.groupBy("_part").agg(fold(value).alias("_whole"))
    offsets = offsets.select("_part", fold("_whole").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_offset"))  # a row a part
    out = dealt.withColumn("_own", fold(value).over(own)).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.coalesce(join(F.col("_offset"), F.col("_own")), "_offset", "_own")).drop("_part", "_own", "_offset")
