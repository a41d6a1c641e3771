"""Event traces: typed views of trace lines, message pairing, comparison and carving.

A trace line has run, seq (the total order), t (nanoseconds, when it was durable), kind ('send',
'deliver', 'drop', 'fault', 'log'), node, event and data (JSON text). A decision may be older than its
line: decided time is data.decidedNs where present, else t. Order is always by seq, never by t.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import FNV_OFFSET, FNV_PRIME, MAX_U64

LINE = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("t", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("event", T.StringType()),
    T.StructField("fault", T.StringType()),
    T.StructField("data", T.StringType()),
])

#: Fields that checks and measures read from an event's data, by event. Big numbers may come as JSON text.
VIEWS: dict[str, str] = {
    "raft_leader": "range_id long, server long, term long",
    "raft_append": "range_id long, server long, idx long, term long, hash string",
    "raft_truncate": "range_id long, server long, from_idx long",
    "raft_commit": "range_id long, server long, idx long, term long",
    "raft_apply": "range_id long, server long, idx long, term long, hash string, effect string",
    "raft_config": "range_id long, server long, voters array<long>, joining array<long>",
    "raft_snapshot": "range_id long, server long, last_idx long, term long, taken boolean",
    "raft_refused": "range_id long, server long",
    "raft_vote": "range_id long, server long, term long, granted boolean",
    "range_created": "range_id long, server long, idx long, term long",
    "range_descriptor": "range_id long, idx long, start string, stop string, generation long, state string",
    "range_removed": "range_id long, server long",
    "range_split": "range_id long, idx long, left_start string, split_at string, right_stop string, right_id long, generation long",
    "range_ids_leased": "idx long, node long, run_id decimal(20,0), first_id long, last_id long",
    "meta_applied": "idx long, range_id long, generation long, start string, stop string",
    "client_invoke": "client long, client_seq long, op string, key string, expect string, value string",
    "client_return": "client long, client_seq long, result string, value string, swapped boolean",
    "client_send": "client long, client_seq long, invoked long, range_id long, generation long, key string",
    "client_mismatch": "client long, invoked long, generation long, start string, stop string",
    "node_crashed": "server long",
    "node_restarted": "server long",
    "partition_started": "id long",
    "partition_healed": "id long",
}


def decided_ns() -> Column:
    return F.coalesce(F.get_json_object("data", "$.decidedNs").cast("long"), F.col("t"))


def view(lines: DataFrame, event: str) -> DataFrame:
    """The lines of one event with its fields as typed columns, in run, seq, t and decided_ns."""
    own = lines.filter((F.col("kind") == "log") & (F.col("event") == event))
    fields = F.from_json("data", VIEWS[event])
    return own.select("run", "seq", "t", decided_ns().alias("decided_ns"), "node", fields.alias("d")).select("run", "seq", "t", "decided_ns", "node", "d.*")


def to_lines(rows: DataFrame, event: str, keep: tuple[str, ...] = ("run", "seq", "t", "node")) -> DataFrame:
    """Undoes view(): typed rows as trace lines of one event."""
    fields = [c for c in rows.columns if c not in (*keep, "decided_ns")]
    return rows.select("run", "seq", "t", F.lit("log").alias("kind"), F.col("node").cast("int").alias("node"), F.lit(event).alias("event"), F.lit(None).cast("string").alias("fault"), F.to_json(F.struct(*fields)).alias("data"))


def kinds(lines: DataFrame, by: str = "kind") -> DataFrame:
    return lines.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def carve(lines: DataFrame, range_id: int) -> DataFrame:
    """The lines that concern one range: by their own field, or by a message in a batch."""
    own = F.get_json_object("data", "$.range_id").cast("long") == range_id
    batch = F.from_json(F.get_json_object("data", "$.msgs"), "array<struct<range_id: long>>")
    return lines.filter(F.coalesce(own, F.lit(False)) | F.coalesce(F.exists(batch, lambda m: m["range_id"] == range_id), F.lit(False)))


def send_deliver(sends: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Each message with how often and how fast it arrived: (msg_id, delivered, first_delay, duplicates)."""
    got = deliveries.groupBy("msg_id").agg(F.count(F.lit(1)).alias("delivered"), F.min("t").alias("first_t"))
    return sends.join(got, "msg_id", "left").select("msg_id", F.coalesce("delivered", F.lit(0)).cast("long").alias("delivered"), (F.col("first_t") - F.col("t")).alias("first_delay"), F.greatest(F.coalesce("delivered", F.lit(0)) - 1, F.lit(0)).cast("long").alias("duplicates"))


def lost(sends: DataFrame, deliveries: DataFrame) -> DataFrame:
    return sends.join(deliveries.select("msg_id").distinct(), "msg_id", "left_anti")


def unsent(sends: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Deliveries of messages that nobody sent, or of one sent to another receiver, or earlier than sent."""
    known = sends.select("msg_id", F.col("receiver").alias("to"), F.col("seq").alias("sent_seq"))
    return deliveries.join(known, "msg_id", "left").filter("to is null or to <> receiver or sent_seq >= seq").select("msg_id", "receiver", "seq")


def echo_stats(pings: DataFrame, pongs: DataFrame) -> DataFrame:
    """Per node its pings, those answered, pongs that answer none outstanding (made up, or a second time), and what that
    violates. Both have node, peer, number, seq; a pong answers a ping of its number that was sent before it."""
    from pyspark.sql.window import Window

    key = ["node", "peer", "number"]
    sent = pings.groupBy(*key).agg(F.min("seq").alias("pinged"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
    told = pongs.join(sent, key, "left").withColumn("nth", nth)
    good = F.col("pinged").isNotNull() & (F.col("pinged") < F.col("seq")) & (F.col("nth") == 1)
    heard = told.groupBy("node").agg(F.count_if(good).alias("answered"), F.count_if(~good).alias("unknown"))
    out = pings.groupBy("node").agg(F.count(F.lit(1)).alias("sent")).join(heard, "node", "full").na.fill(0, ["sent", "answered", "unknown"])
    what = F.when(F.col("unknown") > 0, "unknown pongs").when((F.col("answered") == 0) | (F.col("answered") > F.col("sent")), "no pongs")
    return out.select("node", "sent", "answered", "unknown", (F.col("sent") - F.col("answered")).alias("outstanding"), what.alias("violation"))


def partition_leaks(deliveries: DataFrame, partitions: DataFrame) -> DataFrame:
    """Messages (msg_id, sender, receiver, t) delivered after a partition (sender, receiver, from_t, until_t) of their way
    began and until it ended."""
    from ..functions.intervals import covering

    spans = partitions.select("sender", "receiver", (F.col("from_t") + 1).alias("shut"), (F.col("until_t") + 1).alias("open"))
    return covering(deliveries, spans, "t", "shut", "open", ["sender", "receiver"]).select("msg_id", "sender", "receiver", "t").distinct()


def first_difference(recorded: DataFrame, replayed: DataFrame) -> DataFrame:
    """The first line number where two traces (line, body) differ, with both bodies; no row if they agree."""
    both = recorded.select("line", F.col("body").alias("recorded")).join(replayed.select("line", F.col("body").alias("replayed")), "line", "full")
    apart = both.filter(~F.col("recorded").eqNullSafe(F.col("replayed")))
    return apart.agg(F.min_by(F.struct("line", "recorded", "replayed"), "line").alias("d")).filter("d is not null").select("d.line", "d.recorded", "d.replayed")


def body_digest(lines: DataFrame) -> DataFrame:
    """A digest of the numbered bodies that any change, loss or exchange of lines alters: computed in parallel.

    Each line counts by the first 60 bits of an MD5 of its number and body, a missing body as an empty one.
    """
    own = F.md5(F.concat(F.col("line").cast("string"), F.lit(":"), F.coalesce("body", F.lit(""))))
    return lines.agg(F.bit_xor(F.conv(F.substring(own, 1, 15), 16, 10).cast("long")).alias("digest"), F.count(F.lit(1)).alias("lines"))


def audit_breaks(chain: DataFrame) -> DataFrame:
    """Entries (chain, seq, payload, digest) of an audit log whose digest isn't sha256(digest before + payload)."""
    from pyspark.sql.window import Window

    before = F.coalesce(F.lag("digest").over(Window.partitionBy("chain").orderBy("seq")), F.lit(""))
    return chain.withColumn("expected", F.sha2(F.concat(before, F.col("payload")), 256)).filter("digest <> expected").select("chain", "seq")


def fnv_body(lines: DataFrame) -> DataFrame:
    """Per run the 64-bit FNV-1a hash of its bodies in order, each ended by a line feed: sequential within a run."""
    def run(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = FNV_OFFSET
        for pdf in frames:  # batches of one run, in order of its lines
            for body in pdf["body"]:
                for byte in f"{body}\n".encode():
                    h = (h ^ byte) * FNV_PRIME & MAX_U64
        yield pd.DataFrame({"run": [key[0]], "hash": [f"{h:016x}"]})

    ordered = lines.select("run", "line", "body").repartition("run").sortWithinPartitions("run", "line")
    return ordered.groupBy("run").applyInPandas(run, "run string, hash string")


def messages_of(lines: DataFrame) -> DataFrame:
    """A row per message of batched sends: (run, seq, node, kind, range_id, term)."""
    batch = F.from_json(F.get_json_object("data", "$.msgs"), "array<struct<kind: string, range_id: long, term: long>>")
    return lines.filter("kind in ('send', 'deliver')").select("run", "seq", "node", F.explode(batch).alias("m")).select("run", "seq", "node", "m.kind", "m.range_id", "m.term")
