"""The driver's tables, and the fixtures that portable SQL derives from them.

A fixture's SQL runs alike on Spark and DuckDB; names in braces are tables or other fixtures.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import numbered

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FIXTURES: dict[str, str] = {
    # the write log: one batch a write
    "log": "SELECT lpad(CAST(user_id AS STRING), 12, '0') AS key, event_id + 1 AS seq, 0 AS ord, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM {events}",
    # the same writes in batches of ten
    "batched_log": "SELECT lpad(CAST(user_id AS STRING), 12, '0') AS key, CAST(floor(event_id / 10) AS BIGINT) + 1 AS seq, CAST(event_id % 10 AS INT) AS ord, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM {events}",
    # another store, whose span is installed
    "other_log": "SELECT lpad(CAST(o_custkey % 200 AS STRING), 12, '0') AS key, o_orderkey + 1 AS seq, 0 AS ord, CASE WHEN o_orderstatus = 'P' THEN 'delete' ELSE 'put' END AS op, o_totalprice AS value FROM {orders}",
    "repairs": "SELECT lpad(CAST(n_nationkey * 3 + 20 AS STRING), 12, '0') AS key, 0 AS ord, CASE WHEN n_regionkey = 2 THEN 'delete' ELSE 'put' END AS op, CAST(n_nationkey AS DOUBLE) AS value FROM {nation}",
    "spans": "SELECT lpad(CAST(r_regionkey * 30 AS STRING), 12, '0') AS start, lpad(CAST(r_regionkey * 30 + 12 AS STRING), 12, '0') AS stop FROM {region}",
    "tables": "SELECT CAST(l_suppkey AS BIGINT) AS number, CAST(l_suppkey % 7 AS INT) AS level, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key, count(*) AS entries, CAST(sum(l_quantity) AS BIGINT) * 64 AS bytes, min(l_orderkey) + 1 AS first_seq, max(l_orderkey) + 1 AS max_seq FROM {lineitem} GROUP BY l_suppkey",
    # log records as written: a segment begins every 500 records and repeats the last 20 of the one before; some are damaged
    "wal": "SELECT CAST(floor(event_id / 500) AS BIGINT) AS segment, event_id + 1 AS seq, (event_id % 7919 = 7000) AS bad, value FROM {events} UNION ALL SELECT CAST(floor(event_id / 500) AS BIGINT) + 1 AS segment, event_id + 1 AS seq, false AS bad, value + 1 AS value FROM {events} WHERE event_id % 500 >= 480",
    "gapped_wal": "SELECT event_id + 1 AS seq, value FROM {events} WHERE event_id % 997 <> 996",
    # commands of four ranges
    "commands": "SELECT user_id % 4 AS range_id, CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS BIGINT) AS idx, 1 + CAST(floor(event_id / 1000) AS BIGINT) AS term, lpad(CAST(user_id AS STRING), 12, '0') AS key, CASE event_type WHEN 'click' THEN 'put' WHEN 'purchase' THEN 'cas' WHEN 'view' THEN 'get' WHEN 'error' THEN 'delete' ELSE 'noop' END AS kind, CAST(floor(value) AS BIGINT) % 3 AS value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value / 3) AS BIGINT) % 3 END AS expect, user_id AS client, CAST(floor(event_id / 300) AS BIGINT) AS client_seq, event_id FROM {events}",
    # acknowledgements: how far three servers (and two joining ones) hold each range's log
    "matches": "SELECT range_id, server, max(idx) AS match_index FROM (SELECT range_id, idx, 1 + CAST(event_id % 5 AS INT) AS server FROM {commands} WHERE kind <> 'noop') m GROUP BY range_id, server",
    # descriptors: ten bootstrap spans of the customer keys, and later updates over them
    "descriptors": "SELECT range_id, min(c_custkey) AS start, max(c_custkey) + 1 AS stop, CAST(1 AS BIGINT) AS generation, CAST(-1 AS BIGINT) AS arrival, 'live' AS state FROM (SELECT c_custkey, 1 + CAST(floor(c_custkey * 10 / (SELECT max(c_custkey) + 1 FROM {customer})) AS BIGINT) AS range_id FROM {customer}) b GROUP BY range_id UNION ALL SELECT 100 + o_orderkey AS range_id, o_custkey AS start, o_custkey + 50 AS stop, 2 + (o_orderkey % 5) AS generation, o_orderkey AS arrival, CASE WHEN o_orderkey % 1500 = 0 THEN 'subsumed' ELSE 'live' END AS state FROM {orders} WHERE o_orderkey % 500 = 0",
    "tiles": "SELECT range_id, start, CASE WHEN range_id % 4 = 2 THEN stop - 3 WHEN range_id % 4 = 3 THEN stop + 2 ELSE stop END AS stop FROM {descriptors} WHERE arrival = -1",
    # a lease an order; sizes run through 1 to 7, so that the blocks of grants have a closed form
    "leases": "SELECT o_orderkey + 1 AS idx, CAST(o_custkey % 5 AS BIGINT) AS node, 1 + (o_orderkey + 1) % 7 AS size FROM {orders}",
    "splits": "SELECT o_orderkey AS idx, 1 + CAST(floor(o_orderkey / 250) AS BIGINT) % 10 AS range_id, o_custkey AS split_at, CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE 1000 + o_orderkey END AS right_id, (o_orderkey % 11 = 5) AS joint FROM {orders} WHERE o_orderkey % 250 = 0",
    # the trace: every event is a line, in the order of event_id; 1 ms a step
    "trace": "SELECT event_id AS seq, event_id * 1000000 AS t, CAST(user_id % 5 AS INT) + 1 AS node, user_id % 4 AS range_id, user_id, event_type, value, CAST(floor(value) AS BIGINT) AS v FROM {events}",
    "leaders": "SELECT range_id, CAST(floor(seq / 97) AS BIGINT) AS term, CASE WHEN seq % 1009 = 5 THEN 9 ELSE CAST(floor(seq / 97) AS BIGINT) % 3 + 1 END AS server, seq, t FROM {trace} WHERE event_type = 'signup'",
    "appends": "SELECT range_id, server, idx, CAST(floor(idx / 60) AS BIGINT) + 1 AS term, CASE WHEN idx % 331 = 7 AND server = 2 THEN idx * 31 + 1 ELSE idx * 31 END AS hash, t.seq * 3 + server AS seq, t.t FROM (SELECT range_id, seq, t, CAST(row_number() OVER (PARTITION BY range_id ORDER BY seq) AS BIGINT) AS idx FROM {trace} WHERE event_type <> 'error') t, (SELECT CAST(r_regionkey + 1 AS BIGINT) AS server FROM {region} WHERE r_regionkey < 3) s",
    "commits": "SELECT range_id, server, idx - CASE WHEN idx % 41 = 0 THEN 3 ELSE 0 END AS idx, term, seq + 4 AS seq, t + 2000000 AS t FROM {appends} WHERE idx % 3 = 0 OR idx % 41 = 0",
    "applies": "SELECT range_id, server, idx, term, hash, CASE WHEN idx % 5 = 0 THEN NULL WHEN idx % 457 = 11 AND server = 3 THEN 'refused' ELSE 'applied' END AS effect, seq + 7 AS seq, t + 3000000 + (idx % 7) * 100000 AS t FROM {appends} WHERE NOT (idx % 613 = 10 AND server = 1)",
    "truncates": "SELECT range_id, server, idx - 1 AS from_idx, seq + 1 AS seq, t FROM {appends} WHERE idx % 50 = 49 AND server = 2",
    "resets": "SELECT range_id, server, seq + 5 AS seq, t FROM {appends} WHERE idx % 211 = 100",
    "descriptor_values": "SELECT range_id, CAST(floor(idx / 40) AS BIGINT) * 40 AS idx, CASE WHEN idx = 400 AND server = 3 THEN 0 ELSE 10 * range_id END AS start, 10 * range_id + 40 + CAST(floor(idx / 40) AS BIGINT) % 3 AS stop, CAST(floor(idx / 40) AS BIGINT) + 1 AS generation, 'live' AS state, server, seq FROM {appends} WHERE idx % 40 = 0",
    "served": "SELECT range_id, server, idx, (range_id * 10 + idx % 44) AS key, CASE WHEN idx % 44 >= 42 THEN 'out_of_span' ELSE 'applied' END AS effect, seq FROM {appends} WHERE server = 1 AND idx > 0",
    "writes_by_owner": "SELECT range_id, idx, CAST(v % 50 AS BIGINT) AS key, 1 + CAST(floor(seq / 500) AS BIGINT) - CASE WHEN seq % 701 = 0 THEN 1 ELSE 0 END AS generation, seq FROM (SELECT range_id, seq, v, CAST(row_number() OVER (PARTITION BY range_id ORDER BY seq) AS BIGINT) AS idx FROM {trace} WHERE event_type IN ('click', 'purchase')) w",
    "mismatches": "SELECT user_id AS client, CAST(floor(seq / 200) AS BIGINT) AS invoked, v % 9 AS generation, v % 20 AS start, v % 20 + 15 AS stop, seq FROM {trace} WHERE event_type = 'error'",
    "sends": "SELECT user_id AS client, CAST(floor(seq / 200) AS BIGINT) AS invoked, v % 25 AS key, v % 10 AS generation, seq FROM {trace} WHERE event_type = 'view'",
    "grants": "SELECT idx, node, server, first_id + CASE WHEN idx % 37 = 0 AND server = 3 THEN 1 ELSE 0 END AS first_id, last_id + CASE WHEN idx % 53 = 0 THEN 1 ELSE 0 END AS last_id, idx * 3 + server AS seq FROM (SELECT idx, node, last_id - size + 1 AS first_id, last_id FROM (SELECT idx, node, size, idx + 21 * CAST(floor(idx / 7) AS BIGINT) + CAST(floor((idx % 7) * (idx % 7 + 1) / 2) AS BIGINT) AS last_id FROM {leases}) c) g, (SELECT CAST(r_regionkey + 1 AS BIGINT) AS server FROM {region} WHERE r_regionkey < 3) s",
    "replica_states": "SELECT range_id, node, CASE event_type WHEN 'error' THEN 'removed' WHEN 'signup' THEN 'created' END AS what, seq FROM {trace} WHERE event_type IN ('error', 'signup')",
    "votes": "SELECT range_id, node, CAST(floor(seq / 97) AS BIGINT) AS term, (v % 2 = 0) AS granted, seq FROM {trace} WHERE event_type = 'purchase'",
    "configs": "SELECT range_id, CAST(0 AS BIGINT) AS seq, 1 AS v1, 2 AS v2, 3 AS v3 FROM (SELECT DISTINCT range_id FROM {trace}) r UNION ALL SELECT range_id, max(seq) AS seq, 1 AS v1, 4 AS v2, CAST(3 + 2 * (range_id % 2) AS INT) AS v3 FROM {appends} WHERE idx = 150 GROUP BY range_id",
    "completions": "SELECT t, range_id, seq FROM {trace} WHERE event_type = 'purchase'",
    "outages": "SELECT t AS from_t, t + 7000000 AS until_t FROM {trace} WHERE seq % 50 = 10",
    "downs": "SELECT DISTINCT 1 + seq % 3 AS server, t AS down_t FROM {trace} WHERE seq % 400 = 123",
    # a range a user, so that keyspace and ranges grow with the trace
    "meta_updates": "SELECT seq AS idx, 1 + user_id AS range_id, user_id * 10 + v % 40 AS start, user_id * 10 + v % 40 + 6 + v % 5 AS stop, CAST(floor(seq / 300) AS BIGINT) + v % 3 AS generation, seq, t FROM {trace} WHERE event_type = 'purchase'",
    # what the updates won: all but those below an earlier one of their range, and a few of these
    "meta_won": "SELECT idx, range_id, start, stop - v AS stop, generation, seq FROM (SELECT *, idx % 3 AS v, max(generation) OVER (PARTITION BY range_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {meta_updates}) u WHERE best IS NULL OR generation >= best OR idx % 7 = 3",
    # descriptors as traced before the meta range named them: some never were, some with another end
    "meta_known": "SELECT range_id, generation, start, CASE WHEN idx % 29 = 4 THEN stop + 1 ELSE stop END AS stop, seq - 1 AS seq FROM {meta_updates} WHERE idx % 31 <> 7",
    "verdicts": "SELECT CAST(seq % 100 AS BIGINT) AS seed, CASE user_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'no_guard' ELSE 'late_fsync' END AS variant, event_type AS check_name, (v % 17 = 0) AS failed FROM {trace}",
    "history": "SELECT user_id AS process, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS pseq, lpad(CAST(v % 10 AS STRING), 12, '0') AS key, CASE event_type WHEN 'click' THEN 'put' WHEN 'purchase' THEN 'cas' WHEN 'view' THEN 'get' WHEN 'error' THEN 'delete' ELSE 'get' END AS op, seq, t FROM {trace}",
    "snapshots": "SELECT range_id, server, idx AS last_idx, term, seq + 2 AS seq, (server = 1) AS taken FROM {appends} WHERE idx % 100 = 0 AND server <> 2",
    "leader_reads": "SELECT seq AS read_id, range_id, CAST(1 + user_id % 3 AS BIGINT) AS server, 1 + CAST(floor(seq / 40) AS BIGINT) AS first_of_term, seq * 3 AS seq, t, CASE WHEN seq % 4 = 0 THEN t + (v % 3 - 1) * 1000 END AS lease_until, (seq % 6 <> 1) AS able2, (seq % 9 > 2) AS able3 FROM {trace} WHERE event_type = 'view'",
    "read_acks": "SELECT read_id, server, seq + 5 + (seq + server) % 7 AS seq FROM (SELECT r.read_id, r.seq, s.server FROM {leader_reads} r, (SELECT CAST(r_regionkey + 1 AS BIGINT) AS server FROM {region} WHERE r_regionkey < 3) s) a WHERE (seq + server) % 5 <> 0",
    "adoptions": "SELECT node, run, run - CASE WHEN seq % 9 = 0 THEN 1 ELSE 0 END AS granted_run, seq * 10 AS first_id, seq * 10 + v % 4 AS last_id, seq FROM (SELECT node, CAST(floor(seq / 700) AS BIGINT) AS run, v, seq FROM {trace} WHERE event_type = 'signup') a UNION ALL SELECT node, CAST(floor(seq / 700) AS BIGINT) AS run, CAST(floor(seq / 700) AS BIGINT) AS granted_run, seq * 10 AS first_id, seq * 10 + v % 4 AS last_id, seq + 1 AS seq FROM {trace} WHERE event_type = 'signup' AND seq % 10 = 5 AND seq % 700 < 699 AND seq % 9 <> 0",
    # lines as a trace file holds them
    "lines": "SELECT 'run-1' AS run, seq, t, CASE WHEN seq % 10 = 3 THEN 'deliver' WHEN seq % 10 = 7 THEN 'drop' ELSE 'log' END AS kind, node, CASE WHEN seq % 10 = 3 OR seq % 10 = 7 THEN NULL ELSE CASE (seq + user_id) % 16 WHEN 0 THEN 'raft_leader' WHEN 1 THEN 'raft_commit' WHEN 2 THEN 'raft_apply' WHEN 3 THEN 'raft_truncate' WHEN 4 THEN 'raft_snapshot' WHEN 5 THEN 'client_invoke' WHEN 6 THEN 'client_send' WHEN 7 THEN 'client_mismatch' WHEN 8 THEN 'raft_read' WHEN 9 THEN 'meta_applied' WHEN 10 THEN 'range_ids_leased' WHEN 11 THEN 'range_split' WHEN 12 THEN 'partition_started' WHEN 13 THEN 'node_crashed' WHEN 14 THEN 'inbox_dropped' ELSE 'range_mismatch_sent' END END AS event, CASE WHEN seq % 10 = 7 AND seq % 4 = 1 THEN 'injected' END AS fault, concat(chr(123), '\"range_id\":', CAST(range_id AS STRING), ',\"idx\":', CAST(v AS STRING), ',\"term\":', CAST(1 + seq % 3 AS STRING), ',\"won\":', CAST(seq % 2 AS STRING), ',\"dup\":', CASE WHEN seq % 4 = 1 THEN 'true' ELSE 'false' END, ',\"op\":\"', CASE seq % 4 WHEN 0 THEN 'put' WHEN 1 THEN 'get' WHEN 2 THEN 'delete' ELSE 'cas' END, '\"', chr(125)) AS data FROM {trace}",
    "pongs": "SELECT m.sender AS node, d.receiver AS peer, d.msg_id AS number, d.seq FROM {deliveries} d JOIN {messages} m ON m.msg_id = d.msg_id UNION ALL SELECT sender AS node, receiver AS peer, -msg_id AS number, seq + 9 AS seq FROM {messages} WHERE msg_id % 41 = 0",
    "messages": "SELECT seq AS msg_id, node AS sender, 1 + CAST((node + v) % 5 AS INT) AS receiver, seq, t FROM {trace} WHERE event_type IN ('click', 'view')",
    "deliveries": "SELECT msg_id, receiver, seq + 2 AS seq, t + 1000000 + (msg_id % 9) * 50000 AS t FROM {messages} WHERE msg_id % 23 <> 0 UNION ALL SELECT msg_id, receiver, seq + 3 AS seq, t + 4000000 AS t FROM {messages} WHERE msg_id % 29 = 0",
    "audit": "SELECT event_id AS seq, user_id % 4 AS chain, concat(event_type, ':', CAST(user_id AS STRING)) AS payload FROM {events}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture of that name; in its SQL the window that numbers a range's lines is one task a range."""
    lines = numbered(fixture(spark, sf_dir, "trace").filter("event_type <> 'error'").select("range_id", "seq", "t"), ["range_id"], "seq", "idx")
    servers = fixture(spark, sf_dir, "region").filter("r_regionkey < 3").select((F.col("r_regionkey") + 1).cast("long").alias("server"))
    idx, server = F.col("idx"), F.col("server")
    payload = F.when((idx % 331 == 7) & (server == 2), idx * 31 + 1).otherwise(idx * 31)
    return lines.crossJoin(F.broadcast(servers)).select("range_id", "server", "idx", (F.floor(idx / 60).cast("long") + 1).alias("term"), payload.alias("hash"), (F.col("seq") * 3 + server).alias("seq"), "t")  # three rows


#: Fixtures that Spark makes by another plan than their SQL's; tests hold the rows against it.
PLANNED = {"appends": _appends}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table, or the fixture of that name over them."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name in PLANNED:
        return PLANNED[name](spark, sf_dir)
    sql = FIXTURES[name]
    parts = {part: fixture(spark, sf_dir, part) for part in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **parts)


def with_fixtures(sql: str) -> str:
    """SQL for DuckDB: a WITH clause that defines the fixtures ``{name}`` of ``sql``, and ``sql`` itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in FIXTURES and name not in order:
                visit(FIXTURES[name])
                order.append(name)

    visit(sql)
    # a fixture may not bear the name of one of the driver's tables
    named = ", ".join(f"{name}_fx AS ({FIXTURES[name]})" for name in order)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    body = f", {sql[own.end() :]}" if order and own else sql
    whole = f"WITH {own[1] or '' if own else ''}{named} {body}" if order else body
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else f"{m[1]}_fx", whole)
