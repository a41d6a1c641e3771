"""Queries of replicas' own state, of echo servers, and of what their traces cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import valid_until
from ..operators import checks, kv, measure, ranges, replica, trace
from ..sources import store, wal, wal_sink
from ..sources.tables import fixture, with_fixtures
from .check_queries import _ENTRIES
from .registry import query


def oracle(sql: str) -> str:
    return with_fixtures(sql)


ALIVE = "to_seq >= 4611686018427387904"


@query(oracle("SELECT 2 AS grp, 1 AS purpose, event_id FROM {commands} WHERE range_id = 2 AND kind = 'put'"))
def kv_state_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = fixture(spark, sf_dir, "commands")
    purpose = F.when(F.col("kind") == "put", 1).when(F.col("kind") == "cas", 2).when(F.col("kind") == "get", 0).otherwise(3)
    keyed = commands.select(replica.state_key(F.col("range_id"), purpose, F.encode(F.col("event_id").cast("string"), "UTF-8")).alias("key"))
    own = keyed.filter(replica.in_state(F.col("key"), 2, 1))
    return own.select(F.lit(2).alias("grp"), F.lit(1).alias("purpose"), F.decode(F.substring("key", 25, 99), "UTF-8").cast("long").alias("event_id"))


@query(oracle("""
    WITH r AS (SELECT event_id AS read_id, range_id, key, idx - event_id % 3 AS version FROM {commands} WHERE kind = 'get'),
    w AS (SELECT range_id, key, idx, kind, value FROM {commands} WHERE kind IN ('put', 'delete'))
    SELECT r.read_id, r.range_id, CASE WHEN w.kind = 'put' THEN w.value END AS value, greatest(r.version, 0) AS applied FROM r ASOF LEFT JOIN w ON r.range_id = w.range_id AND r.key = w.key AND r.version >= w.idx
"""))
def kv_reads_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = fixture(spark, sf_dir, "commands")
    reads = commands.filter("kind = 'get'").selectExpr("event_id AS read_id", "range_id", "key", "idx - event_id % 3 AS version")
    return replica.reads_at(replica.apply_batches(commands), reads)


@query(oracle("SELECT range_id, name, max(seq) AS seq, arg_max(value, (seq, ord)) AS value FROM (SELECT range_id, 'k/' || key AS name, idx AS seq, 0 AS ord, value, kind FROM {commands} WHERE kind IN ('put', 'delete') UNION ALL SELECT range_id, 'applied', idx, 1, idx, 'put' FROM {commands}) b GROUP BY range_id, name HAVING arg_max(kind, (seq, ord)) = 'put'"))
def log_apply_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = replica.apply_batches(fixture(spark, sf_dir, "commands"))
    keyed = batches.withColumn("key", F.struct("range_id", "name"))
    return kv.newest(keyed).filter("op = 'put'").select("key.range_id", "key.name", "seq", "value")


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    floors = checks.floors(fixture(spark, sf_dir, "snapshots"))
    appends = replica.above_floor(fixture(spark, sf_dir, "appends"), floors)
    entries = checks.log_view(appends, fixture(spark, sf_dir, "truncates"))
    return replica.retained(entries, floors), floors


_KEPT = f"{_ENTRIES}, f AS (SELECT range_id, server, max(last_idx) AS floor FROM {{snapshots}} GROUP BY ALL), k AS (SELECT e.range_id, e.server, e.idx, e.term, e.hash FROM entries e LEFT JOIN f USING (range_id, server) WHERE {ALIVE} AND (floor IS NULL OR idx > floor))"


@query(oracle(f"WITH {_KEPT} SELECT * FROM k"))
def log_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir)[0]


@query(oracle(f"WITH {_KEPT}, t AS (SELECT range_id, server, max(idx) AS top FROM k GROUP BY ALL) SELECT range_id, server, coalesce(floor, 0) + 1 AS first_index, greatest(coalesce(top, floor, 0), coalesce(floor, 0)) AS last_index FROM t FULL JOIN f USING (range_id, server)"))
def log_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replica.log_bounds(*_kept(spark, sf_dir))


@query(oracle("SELECT range_id, node AS server, term, CASE WHEN granted THEN seq % 5 END AS voted_for FROM {votes} WHERE seq % 23 <> 0 QUALIFY row_number() OVER (PARTITION BY range_id, node ORDER BY term DESC, seq DESC) = 1"))
def log_hard_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "votes").select("range_id", F.col("node").alias("server"), "term", F.when(F.col("granted"), F.col("seq") % 5).alias("voted_for"), (F.col("seq") % 23 != 0).alias("durable"), "seq")
    return replica.hard_state(rows)


@query(oracle("""
    WITH h AS (SELECT r.*, coalesce((SELECT max(c.idx) FROM {commits} c WHERE c.range_id = r.range_id AND c.server = r.server AND c.seq <= r.seq), 0) AS high,
                  (SELECT min(a.seq) FROM {read_acks} a WHERE a.read_id = r.read_id AND a.server <> r.server AND a.seq > r.seq) AS heard, coalesce(lease_until >= t, false) AS lease,
                  (CASE WHEN able2 AND server <> 2 THEN 1 ELSE 0 END + CASE WHEN able3 AND server <> 3 THEN 1 ELSE 0 END + 1) * 2 > 3 AS can FROM {leader_reads} r),
    i AS (SELECT *, greatest(high, first_of_term) AS index, NOT lease AND NOT can AS refused, CASE WHEN NOT (NOT lease AND NOT can) THEN CASE WHEN lease THEN seq ELSE heard END END AS confirmed FROM h),
    s AS (SELECT i.*, (SELECT min(a.seq) FROM {applies} a WHERE a.range_id = i.range_id AND a.server = i.server AND a.idx >= i.index) AS applied FROM i)
    SELECT read_id, range_id, server, index, confirmed, CASE WHEN confirmed IS NOT NULL AND applied IS NOT NULL THEN greatest(confirmed, applied) END AS served,
        CASE WHEN refused THEN 'refused' WHEN confirmed IS NULL THEN 'unconfirmed' WHEN applied IS NULL THEN 'unapplied' ELSE 'served' END AS fate FROM s
"""))
def log_read_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = fixture(spark, sf_dir, "leader_reads")
    able = F.array_compact(F.array(*[F.when(F.col(f"able{s}"), F.lit(s)) for s in (2, 3)])).alias("able")
    return replica.read_index(reads.select("read_id", "range_id", "server", "first_of_term", "seq", "t", "lease_until", able), fixture(spark, sf_dir, "read_acks"), fixture(spark, sf_dir, "commits"), fixture(spark, sf_dir, "applies"), [1, 2, 3])


_LEASES = "(SELECT seq AS read_id, range_id, node AS server, CAST(floor(seq / 97) AS BIGINT) AS term, user_id AS key, seq FROM {trace} WHERE event_type = 'view')"
_REVOKED = "(SELECT range_id, node AS server, CAST(floor(seq / 97) AS BIGINT) AS term, seq FROM {trace} WHERE event_type = 'error')"


@query(oracle(f"SELECT * FROM {_LEASES} r WHERE server <> 3 AND NOT EXISTS (SELECT 1 FROM {_REVOKED} v WHERE v.range_id = r.range_id AND v.server = r.server AND v.term = r.term AND v.seq <= r.seq)"))
def chk_lease_reads_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixture(spark, sf_dir, "trace")
    clocks = fixture(spark, sf_dir, "region").selectExpr("r_regionkey + 1 AS server", "r_regionkey * 60 AS drift_ppm")
    return replica.lease_reads_at_risk(spark.sql(f"SELECT * FROM {_LEASES} r", trace=events), spark.sql(f"SELECT * FROM {_REVOKED} r", trace=events), clocks, 150)


_ADOPTED = "(SELECT node, run, granted_run, first_id, last_id, min(seq) AS seq FROM {adoptions} WHERE run = granted_run GROUP BY ALL)"


@query(oracle(f"""
    WITH t AS (SELECT node, CAST(floor(seq / 700) AS BIGINT) AS run, seq FROM {{trace}} WHERE event_type = 'click'), p AS (SELECT t.*, a.seq AS since, a.first_id, a.last_id FROM t ASOF LEFT JOIN {_ADOPTED} a ON a.node = t.node AND a.run = t.run AND t.seq >= a.seq),
    n AS (SELECT *, first_id + row_number() OVER (PARTITION BY node, run, since ORDER BY seq) - 1 AS id FROM p)
    SELECT node, run, seq, CASE WHEN id <= last_id THEN id END AS id FROM n
"""))
def range_id_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = fixture(spark, sf_dir, "trace").filter("event_type = 'click'").selectExpr("node", "CAST(floor(seq / 700) AS BIGINT) AS run", "seq")
    return replica.id_takes(fixture(spark, sf_dir, "adoptions"), takes)


@query(oracle("""
    WITH s AS (SELECT range_id, start, stop FROM {descriptors} WHERE arrival = -1), n AS (SELECT r_regionkey + 1 AS node, 'host-' || r_name AS address FROM region),
    v AS (SELECT string_agg(CAST(node AS STRING), ',' ORDER BY CAST(node AS STRING)) AS voters FROM n), d AS (SELECT s.*, concat_ws(' ', range_id, start, stop, '1', voters) AS told FROM s, v),
    c AS (SELECT concat_ws(' ', 'range', range_id, start, stop) AS line FROM s UNION ALL SELECT concat_ws(' ', 'node', node, address) FROM n)
    SELECT 'descriptor' AS kind, CAST(range_id AS STRING) AS name, told AS value FROM d UNION ALL SELECT 'meta', CAST(stop AS STRING), told FROM d WHERE range_id >= 2
    UNION ALL SELECT 'counter', '', CAST(greatest(2, max(range_id) + 1) AS STRING) FROM s UNION ALL SELECT 'node', CAST(node AS STRING), address FROM n UNION ALL SELECT 'digest', '', sha256(string_agg(line, chr(10) ORDER BY line)) FROM c
"""))
def range_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = fixture(spark, sf_dir, "descriptors").filter("arrival = -1").select("range_id", "start", "stop")
    return replica.bootstrap_state(spans, fixture(spark, sf_dir, "region").selectExpr("r_regionkey + 1 AS node", "concat('host-', r_name) AS address"))


@query(oracle("SELECT 1 AS expected, min(seq) AS found FROM {wal} WHERE segment >= 1 HAVING min(seq) > 1"))
def kv_head_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.head_gap(fixture(spark, sf_dir, "wal").filter("segment >= 1"), 1)


_FOUND = "(SELECT number, entries + CASE WHEN number % 13 = 5 THEN 1 ELSE 0 END AS entries, first_key, last_key - CASE WHEN number % 17 = 6 THEN 1 ELSE 0 END AS last_key, first_seq, max_seq - CASE WHEN number % 19 = 7 THEN 1 ELSE 0 END AS max_seq FROM {tables} WHERE number % 11 <> 3)"


@query(oracle(f"""
    SELECT number, what FROM (SELECT t.number, CASE WHEN f.number IS NULL THEN 'missing' WHEN f.entries <> t.entries THEN 'entries' WHEN f.first_key <> t.first_key OR f.last_key <> t.last_key THEN 'keys' WHEN f.first_seq <> t.first_seq OR f.max_seq <> t.max_seq THEN 'versions' END AS what
    FROM {{tables}} t LEFT JOIN {_FOUND} f USING (number)) x WHERE what IS NOT NULL
"""))
def kv_damaged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixture(spark, sf_dir, "tables")
    return kv.damaged_tables(tables, spark.sql(f"SELECT * FROM {_FOUND} f", tables=tables))


@query(oracle("SELECT key, seq, CAST(CAST(floor(value) AS BIGINT) AS STRING) AS value FROM (SELECT * FROM {batched_log} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, ord DESC) = 1) n WHERE op <> 'delete'"))
def kv_wal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = fixture(spark, sf_dir, "batched_log").withColumn("value", F.col("value").cast("long").cast("string"))
    path = store.scratch(spark, "segments")
    wal_sink.write_segments(written, path, segment_bytes=1 << 16)
    found = kv.scan_at(wal.writes_of(wal.recovered_prefix(wal.read_segments(spark, path))))
    return found.select(F.decode("key", "UTF-8").alias("key"), "seq", F.decode("value", "UTF-8").alias("value"))


_J = "json_extract_string(data, '$.{0}')"
_IDX, _TERM, _OP, _RANGE, _DUP, _WON = (_J.format(n) for n in ("idx", "term", "op", "range_id", "dup", "won"))


def _event(name: str) -> str:
    return f"count(*) FILTER (WHERE event = '{name}')"


@query(oracle(f"""
    SELECT count(*) AS records, min(t) AS first_t, max(t) AS last_t, {_event('partition_started')} AS partitions, {_event('node_crashed')} AS crashes, count(*) FILTER (WHERE kind = 'deliver' AND {_DUP} = 'true') AS duplicates, count(*) FILTER (WHERE kind = 'drop' AND fault = 'injected') AS drops,
        {_event('raft_leader')} AS leaders, coalesce(bool_or(event = 'raft_leader' AND CAST({_TERM} AS BIGINT) > 1), false) AS terms_above_one, {_event('raft_truncate')} AS truncations, {_event('raft_commit')} AS commits, {_event('raft_apply')} AS applies, {_event('raft_snapshot')} AS snapshot_actions,
        coalesce(max(CAST({_IDX} AS BIGINT)) FILTER (WHERE event IN ('raft_append', 'raft_commit', 'raft_apply')), 0) AS highest_index,
        {', '.join(f"count(*) FILTER (WHERE event = 'client_invoke' AND {_OP} = '{op}') AS {name}" for op, name in (('put', 'puts'), ('get', 'gets'), ('delete', 'deletes'), ('cas', 'cas')))},
        {_event('client_mismatch')} AS client_mismatches, {_event('client_send')} AS client_sends, count(*) FILTER (WHERE event = 'raft_read' AND CAST({_RANGE} AS BIGINT) <= 1) AS lookups_served,
        count(*) FILTER (WHERE event = 'meta_applied' AND CAST({_IDX} AS BIGINT) > 0) AS meta_applies, count(*) FILTER (WHERE event = 'meta_applied' AND CAST({_IDX} AS BIGINT) > 0 AND CAST({_WON} AS BIGINT) > 0) AS meta_took, {_event('range_ids_leased')} AS ids_leased, {_event('range_split')} AS splits
    FROM {{lines}}
"""))
def m_coverage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.coverage_counters(fixture(spark, sf_dir, "lines"))


@query(oracle(f"""
    WITH x AS (SELECT event, {_RANGE} AS r, {_OP} AS o FROM {{lines}})
    SELECT 'records' AS counter, r AS name, count(*) AS n FROM x WHERE r IS NOT NULL GROUP BY r UNION ALL SELECT 'leaders', r, count(*) FROM x WHERE event = 'raft_leader' GROUP BY r UNION ALL SELECT 'applies', r, count(*) FROM x WHERE event = 'raft_apply' GROUP BY r
    UNION ALL SELECT 'inbox_drops', o || '/' || r, count(*) FROM x WHERE event = 'inbox_dropped' GROUP BY ALL UNION ALL SELECT 'mismatches', o, count(*) FROM x WHERE event = 'range_mismatch_sent' GROUP BY o
"""))
def m_coverage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.coverage_groups(fixture(spark, sf_dir, "lines"))


_SPANS = "(SELECT range_id, start, stop, seq AS from_seq, lead(seq) OVER (PARTITION BY range_id ORDER BY seq) AS to_seq FROM {descriptor_values} WHERE server = 1)"


@query(oracle(f"""
    WITH s AS (SELECT * FROM {_SPANS} x), b AS (SELECT DISTINCT low FROM (SELECT start AS low FROM s UNION ALL SELECT stop FROM s UNION ALL SELECT -5 UNION ALL SELECT 90) x WHERE low BETWEEN -5 AND 90),
    e AS (SELECT low, lead(low) OVER (ORDER BY low) AS high FROM b)
    SELECT c.range_id, c.seq, min(e.low) AS low FROM {{truncates}} c, e WHERE e.high IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.start <= e.low AND s.stop > e.low AND s.from_seq <= c.seq AND coalesce(s.to_seq, 4611686018427387904) > c.seq) GROUP BY ALL
"""))
def chk_tiling_after_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = valid_until(fixture(spark, sf_dir, "descriptor_values").filter("server = 1").select("range_id", "start", "stop", F.col("seq").alias("from_seq")), ["range_id"], "from_seq", "to_seq")
    return checks.tiling_after(held, fixture(spark, sf_dir, "truncates").select("range_id", "seq"), -5, 90)


@query(oracle(f"WITH s AS (SELECT * FROM {_SPANS} x) SELECT a.range_id, a.from_seq AS seq, min(greatest(a.start, b.start)) AS low FROM s a JOIN s b ON a.range_id <> b.range_id AND a.start < b.stop AND b.start < a.stop AND b.from_seq < a.from_seq AND coalesce(b.to_seq, 4611686018427387904) > a.from_seq GROUP BY ALL"))
def chk_overlap_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = valid_until(fixture(spark, sf_dir, "descriptor_values").filter("server = 1").select("range_id", "start", "stop", F.col("seq").alias("from_seq")), ["range_id"], "from_seq", "to_seq")
    return checks.owner_overlap(held.withColumn("node", F.lit(0))).select("range_id", "seq", "low")


@query(oracle("""
    WITH q AS (SELECT p.*, m.seq AS pinged, row_number() OVER (PARTITION BY p.node, p.peer, p.number ORDER BY p.seq) AS k FROM {pongs} p LEFT JOIN {messages} m ON m.sender = p.node AND m.receiver = p.peer AND m.msg_id = p.number AND m.seq < p.seq),
    g AS (SELECT node, count(*) FILTER (WHERE pinged IS NOT NULL AND k = 1) AS answered, count(*) FILTER (WHERE pinged IS NULL OR k > 1) AS unknown FROM q GROUP BY node), s AS (SELECT sender AS node, count(*) AS sent FROM {messages} GROUP BY sender)
    SELECT node, coalesce(sent, 0) AS sent, coalesce(answered, 0) AS answered, coalesce(unknown, 0) AS unknown, coalesce(sent, 0) - coalesce(answered, 0) AS outstanding, CASE WHEN coalesce(unknown, 0) > 0 THEN 'unknown pongs' WHEN coalesce(answered, 0) = 0 THEN 'no pongs' END AS violation FROM s FULL JOIN g USING (node)
"""))
def trace_echo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pings = fixture(spark, sf_dir, "messages").select(F.col("sender").alias("node"), F.col("receiver").alias("peer"), F.col("msg_id").alias("number"), "seq")
    return trace.echo_stats(pings, fixture(spark, sf_dir, "pongs"))


_CUT = "(SELECT 1 + CAST(seq % 5 AS INT) AS sender, 1 + CAST(floor(seq / 7) AS INT) % 5 AS receiver, t AS from_t, t + 300000000 AS until_t FROM {trace} WHERE event_type = 'error')"


@query(oracle(f"SELECT DISTINCT d.msg_id, m.sender, d.receiver, d.t FROM {{deliveries}} d JOIN {{messages}} m USING (msg_id) JOIN {_CUT} c ON c.sender = m.sender AND c.receiver = d.receiver AND d.t > c.from_t AND d.t <= c.until_t"))
def trace_partition_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fixture(spark, sf_dir, "deliveries").select("msg_id", "receiver", "t").join(fixture(spark, sf_dir, "messages").select("msg_id", "sender"), "msg_id")
    return trace.partition_leaks(moved, spark.sql(f"SELECT * FROM {_CUT} c", trace=fixture(spark, sf_dir, "trace")))


@query(oracle("SELECT seq, node, CASE WHEN k = 0 THEN 'append' ELSE 'beat' END AS kind, (range_id + k) % 4 AS range_id, v AS term FROM {trace}, (SELECT unnest([0, 1]) AS k) u WHERE event_type = 'click'"))
def trace_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "trace").filter("event_type = 'click'")
    batch = F.array(*[F.struct(F.lit(kind).alias("kind"), ((F.col("range_id") + k) % 4).alias("range_id"), F.col("v").alias("term")) for k, kind in enumerate(("append", "beat"))])
    lines = rows.select(F.lit("r").alias("run"), "seq", "node", F.lit("send").alias("kind"), F.to_json(F.struct(batch.alias("msgs"))).alias("data"))
    return trace.messages_of(lines).drop("run")


_LEARNED = """l AS (SELECT r.r_regionkey AS client, d.* FROM {descriptors} d JOIN region r ON d.range_id % 5 = r.r_regionkey OR d.arrival < 0),
    b AS (SELECT DISTINCT client, low FROM (SELECT client, start AS low FROM l UNION ALL SELECT client, stop FROM l) x),
    e AS (SELECT client, low, lead(low) OVER (PARTITION BY client ORDER BY low) AS high FROM b),
    o AS (SELECT e.client, e.low, e.high, l.range_id, l.generation FROM e JOIN l ON l.client = e.client AND e.low >= l.start AND e.low < l.stop WHERE e.high IS NOT NULL QUALIFY row_number() OVER (PARTITION BY e.client, e.low ORDER BY l.generation DESC, l.arrival) = 1),
    f AS (SELECT *, CASE WHEN lag(high) OVER w = low AND lag(range_id) OVER w = range_id AND lag(generation) OVER w = generation THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY client ORDER BY low)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY client ORDER BY low) AS island FROM f),
    c AS (SELECT client, range_id, generation, min(low) AS low, max(high) AS high FROM g GROUP BY client, island, range_id, generation)"""


@query(oracle(f"WITH {_LEARNED} SELECT client, low, high, range_id, generation FROM c WHERE NOT EXISTS (SELECT 1 FROM {{orders}} k WHERE k.o_custkey % 5 = c.client AND k.o_totalprice > 490000 AND k.o_custkey >= c.low AND k.o_custkey < c.high)"))
def range_cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = fixture(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("client"))
    descriptors = fixture(spark, sf_dir, "descriptors")
    learned = descriptors.join(F.broadcast(clients), (descriptors["range_id"] % 5 == clients["client"]) | (descriptors["arrival"] < 0))  # the five regions
    misses = fixture(spark, sf_dir, "orders").filter("o_totalprice > 490000").selectExpr("o_custkey % 5 AS client", "o_custkey AS key")
    return ranges.evict(ranges.merge_generation(learned, ("client",)), misses, ("client",))


@query(oracle("SELECT client, range_id, leader FROM (SELECT user_id AS client, range_id, CASE WHEN event_type = 'signup' THEN node END AS leader, seq FROM {trace} WHERE event_type IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY user_id, range_id ORDER BY seq DESC) = 1) h WHERE leader IS NOT NULL"))
def range_leader_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixture(spark, sf_dir, "trace").filter("event_type in ('signup', 'error')")
    return ranges.leader_hints(events.select(F.col("user_id").alias("client"), "range_id", F.when(F.col("event_type") == "signup", F.col("node")).alias("leader"), "seq"))
