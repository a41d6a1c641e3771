"""Queries of the trace checks over traces derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import valid_until
from ..operators import checks, trace
from ..sources import jsonl, store
from ..sources.tables import fixture, with_fixtures
from .registry import query


def oracle(sql: str) -> str:
    return with_fixtures(sql)


_ENTRIES = """entries AS (SELECT range_id, server, idx, term, hash, seq AS from_seq,
    least(coalesce(lead(seq) OVER (PARTITION BY range_id, server, idx ORDER BY seq), 4611686018427387904),
          coalesce((SELECT min(c.seq) FROM {truncates} c WHERE c.range_id = a.range_id AND c.server = a.server AND c.seq > a.seq AND c.from_idx <= a.idx), 4611686018427387904)) AS to_seq FROM {appends} a)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.log_view(fixture(spark, sf_dir, "appends"), fixture(spark, sf_dir, "truncates"))


@query(oracle("SELECT range_id, term, leaders, seq FROM (SELECT l.range_id, l.term, (SELECT count(DISTINCT server) FROM {leaders} k WHERE k.range_id = l.range_id AND k.term = l.term) AS leaders, min(l.seq) AS seq FROM {leaders} l WHERE l.server <> (SELECT arg_min(server, seq) FROM {leaders} k WHERE k.range_id = l.range_id AND k.term = l.term) GROUP BY l.range_id, l.term) x"))
def chk_election_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.election_safety(fixture(spark, sf_dir, "leaders"))


@query(oracle(f"WITH {_ENTRIES} SELECT range_id, server, idx, term, hash, from_seq, CASE WHEN to_seq < 4611686018427387904 THEN to_seq END AS to_seq FROM entries"))
def chk_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)


@query(oracle(f"""
    WITH {_ENTRIES}, p AS (SELECT x.range_id, x.idx, x.term, x.server AS a, y.server AS b, x.hash = y.hash AS same, greatest(x.from_seq, y.from_seq) AS seq FROM entries x JOIN entries y USING (range_id, idx, term) WHERE x.server < y.server AND x.to_seq > y.from_seq AND y.to_seq > x.from_seq),
    w AS (SELECT p.*, CASE WHEN NOT same THEN 'payload' WHEN (m.term, m.hash) IS DISTINCT FROM (n.term, n.hash) THEN 'before' END AS what FROM p
          LEFT JOIN entries m ON m.range_id = p.range_id AND m.server = p.a AND m.idx = p.idx - 1 AND m.from_seq <= p.seq AND m.to_seq > p.seq
          LEFT JOIN entries n ON n.range_id = p.range_id AND n.server = p.b AND n.idx = p.idx - 1 AND n.from_seq <= p.seq AND n.to_seq > p.seq)
    SELECT range_id, idx, term, a, b, what, seq FROM w WHERE what IS NOT NULL
"""))
def chk_log_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.log_matching(_entries(spark, sf_dir))


_LEADERS = "(SELECT range_id, server, term, min(seq) AS seq FROM {leaders} WHERE server <= 3 GROUP BY ALL)"


@query(oracle(f"""
    WITH {_ENTRIES}, committed AS (SELECT range_id, idx, arg_min(term, seq) AS term, min(term) AS in_term, min(seq) AS at_seq FROM {{commits}} GROUP BY range_id, idx),
    due AS (SELECT l.range_id, l.server, l.term AS led, l.seq AS elected, c.idx, c.term FROM {_LEADERS} l JOIN committed c ON c.range_id = l.range_id AND c.in_term < l.term AND c.at_seq < l.seq)
    SELECT range_id, led, server, min(idx) AS idx, min(elected) AS seq FROM due d WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.range_id = d.range_id AND e.server = d.server AND e.idx = d.idx AND e.term = d.term AND e.from_seq <= d.elected AND e.to_seq > d.elected) GROUP BY range_id, led, server
"""))
def chk_leader_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaders = fixture(spark, sf_dir, "leaders").filter("server <= 3").groupBy("range_id", "server", "term").agg(F.min("seq").alias("seq"))
    commits = fixture(spark, sf_dir, "commits").withColumn("entry_term", F.col("term"))
    return checks.leader_completeness(commits, leaders, _entries(spark, sf_dir))


@query(oracle(f"""
    WITH {_ENTRIES}, c AS (SELECT range_id, server, idx, term, seq FROM {{commits}}),
    held AS (SELECT c.range_id, c.server, c.idx, c.term, c.seq, count(DISTINCT e.server) AS holders,
                count(DISTINCT e.server) FILTER (WHERE e.server IN (1, 2, 3)) AS early, count(DISTINCT e.server) FILTER (WHERE e.server IN (1, 4, 3 + 2 * (c.range_id % 2))) AS late
             FROM c LEFT JOIN entries e ON e.range_id = c.range_id AND e.idx = c.idx AND e.term = c.term AND e.from_seq <= c.seq AND e.to_seq > c.seq GROUP BY ALL),
    since AS (SELECT range_id, max(seq) AS seq FROM {{configs}} WHERE seq > 0 GROUP BY range_id)
    SELECT h.range_id, h.server, h.idx, h.holders, h.seq FROM held h LEFT JOIN since s USING (range_id) WHERE CASE WHEN s.seq <= h.seq THEN late ELSE early END * 2 <= 3
"""))
def chk_commit_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    voters = F.array(*[F.col(c).cast("long") for c in ("v1", "v2", "v3")])
    configs = fixture(spark, sf_dir, "configs").select("range_id", "seq", voters.alias("voters"), F.lit(None).cast("array<bigint>").alias("joining"))
    commits = fixture(spark, sf_dir, "commits").select("range_id", "server", "idx", "term", "seq")
    return checks.commit_majority(commits, _entries(spark, sf_dir), configs)


@query(oracle(f"WITH {_ENTRIES} SELECT c.range_id, c.server, c.idx, c.term AS led, e.term, c.seq FROM {{commits}} c JOIN entries e USING (range_id, server, idx) WHERE e.from_seq <= c.seq AND e.to_seq > c.seq AND c.term <> e.term"))
def chk_commit_current_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.commit_current_term(fixture(spark, sf_dir, "commits"), _entries(spark, sf_dir))


@query(oracle("""
    WITH t AS (SELECT t.*, coalesce((SELECT max(r.seq) FROM {resets} r WHERE r.range_id = t.range_id AND r.server = t.server AND r.seq < t.seq), -1) AS since FROM {truncates} t)
    SELECT t.range_id, t.server, t.from_idx, max(c.idx) AS committed, t.seq FROM t JOIN {commits} c ON c.range_id = t.range_id AND c.server = t.server AND c.seq <= t.seq AND c.seq > t.since GROUP BY ALL HAVING t.from_idx <= max(c.idx)
"""))
def chk_committed_not_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.committed_not_truncated(fixture(spark, sf_dir, "commits"), fixture(spark, sf_dir, "truncates"), fixture(spark, sf_dir, "resets"))


@query(oracle("SELECT range_id, idx, count(DISTINCT (term, hash)) AS entries, count(DISTINCT effect) AS effects, min(seq) AS seq FROM {applies} GROUP BY range_id, idx HAVING count(DISTINCT (term, hash)) > 1 OR count(DISTINCT effect) > 1"))
def chk_state_machine_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.state_machine_safety(fixture(spark, sf_dir, "applies"))


@query(oracle("SELECT range_id, server, before, idx, seq FROM (SELECT *, lag(idx) OVER (PARTITION BY range_id, server ORDER BY seq) AS before FROM {applies}) a WHERE idx <> before + 1"))
def chk_apply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.apply_order(fixture(spark, sf_dir, "applies"))


_STATED = "(SELECT range_id, idx + 3 AS idx, start, stop + CASE WHEN idx = 80 THEN 1 ELSE 0 END AS stop, generation, state, seq + 50 AS seq FROM {descriptor_values} WHERE server = 2)"


@query(oracle(f"""
    WITH a AS (SELECT range_id, idx, arg_min((start, stop, generation, state), seq) AS v FROM (SELECT *, row_number() OVER () AS k FROM {{descriptor_values}}) d GROUP BY range_id, idx)
    SELECT range_id, idx, 'two values' AS what, max(seq) AS seq FROM {{descriptor_values}} GROUP BY range_id, idx HAVING count(DISTINCT (start, stop, generation, state)) > 1
    UNION ALL SELECT s.range_id, s.idx, 'restated otherwise', s.seq FROM {_STATED} s ASOF LEFT JOIN a ON a.range_id = s.range_id AND s.idx >= a.idx WHERE a.v IS NULL OR a.v IS DISTINCT FROM (s.start, s.stop, s.generation, s.state)
"""))
def chk_descriptor_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = fixture(spark, sf_dir, "descriptor_values")
    stated = values.filter("server = 2").selectExpr("range_id", "idx + 3 AS idx", "start", "stop + CASE WHEN idx = 80 THEN 1 ELSE 0 END AS stop", "generation", "state", "seq + 50 AS seq")
    return checks.descriptor_agreement(values, stated)


@query(oracle("""
    WITH a AS (SELECT range_id, idx, arg_min(start, seq) AS start, arg_min(stop, seq) AS stop FROM {descriptor_values} GROUP BY range_id, idx),
    j AS (SELECT s.range_id, s.idx, s.seq, s.effect, a.start, (s.key >= a.start AND s.key < a.stop) AS inside FROM {served} s ASOF LEFT JOIN a ON a.range_id = s.range_id AND s.idx > a.idx),
    w AS (SELECT *, CASE WHEN start IS NULL THEN 'no descriptor' WHEN effect = 'applied' AND NOT inside THEN 'served outside' WHEN effect = 'out_of_span' AND inside THEN 'refused inside' END AS what FROM j)
    SELECT range_id, idx, what, seq FROM w WHERE what IS NOT NULL
"""))
def chk_serving_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.serving_span(fixture(spark, sf_dir, "served"), fixture(spark, sf_dir, "descriptor_values"))


@query(oracle("SELECT key, last_range, range_id, last_generation, generation, seq FROM (SELECT *, lag(generation) OVER w AS last_generation, lag(range_id) OVER w AS last_range FROM {writes_by_owner} WINDOW w AS (PARTITION BY key ORDER BY seq)) x WHERE generation < last_generation OR (range_id <> last_range AND generation <= last_generation)"))
def chk_generations_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.generations_rise(fixture(spark, sf_dir, "writes_by_owner"))


@query(oracle("""
    WITH b AS (SELECT DISTINCT low FROM (SELECT start AS low FROM {meta_won} UNION ALL SELECT stop FROM {meta_won}) x), e AS (SELECT low, lead(low) OVER (ORDER BY low) AS high FROM b),
    n AS (SELECT e.low, e.high, u.idx, u.range_id, u.generation, u.seq, max(u.generation) OVER (PARTITION BY e.low ORDER BY u.idx RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {meta_won} u JOIN e ON e.low >= u.start AND e.low < u.stop WHERE e.high IS NOT NULL)
    SELECT low, high, idx, range_id, before, generation, seq FROM n WHERE generation < before
"""))
def chk_meta_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.meta_monotone(fixture(spark, sf_dir, "meta_won"))


@query(oracle("""
    WITH k AS (SELECT range_id, generation, arg_min(start, seq) AS start, arg_min(stop, seq) AS stop, min(seq) AS seq FROM {meta_known} GROUP BY range_id, generation),
    w AS (SELECT u.idx, u.range_id, u.generation, CASE WHEN k.seq IS NULL OR k.seq > u.seq THEN 'unknown' WHEN k.start <> u.start OR k.stop <> u.stop THEN 'differs' END AS what, u.seq FROM {meta_updates} u LEFT JOIN k USING (range_id, generation))
    SELECT idx, range_id, generation, what, seq FROM w WHERE what IS NOT NULL
"""))
def chk_meta_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.meta_named(fixture(spark, sf_dir, "meta_updates"), fixture(spark, sf_dir, "meta_known"))


@query(oracle("SELECT s.client, s.invoked, s.key, s.generation AS sent, s.seq, max(m.generation) AS named FROM {sends} s JOIN {mismatches} m ON m.client = s.client AND m.invoked = s.invoked AND m.seq < s.seq AND s.key >= m.start AND s.key < m.stop GROUP BY ALL HAVING s.generation < max(m.generation)"))
def chk_client_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.client_refresh(fixture(spark, sf_dir, "sends"), fixture(spark, sf_dir, "mismatches"))


@query(oracle("""
    WITH f AS (SELECT * FROM {grants} QUALIFY row_number() OVER (PARTITION BY idx ORDER BY seq) = 1)
    SELECT idx, 'overlap' AS what, seq FROM (SELECT *, max(last_id) OVER (ORDER BY first_id, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f) x WHERE first_id <= reach
    UNION ALL SELECT idx, 'empty', seq FROM f WHERE first_id > last_id
    UNION ALL SELECT g.idx, 'replicas differ', min(g.seq) FROM {grants} g JOIN f USING (idx) WHERE g.first_id <> f.first_id OR g.last_id <> f.last_id GROUP BY g.idx
"""))
def chk_ids_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.ids_unique(fixture(spark, sf_dir, "grants"))


_SPLIT = """(SELECT a.range_id, a.idx + 2 AS idx, a.start + 15 AS split_at, CAST(1 + a.idx AS BIGINT) AS right_id, a.start AS left_start, a.start + 15 AS left_stop, a.start + 15 AS right_start,
    a.stop + CASE WHEN a.idx % 120 = 80 THEN 1 ELSE 0 END AS right_stop, a.generation + 1 AS left_generation, a.generation + CASE WHEN a.idx % 160 = 0 THEN 2 ELSE 1 END AS right_generation, CAST(a.idx % 5 AS BIGINT) AS node, a.seq + 9 AS seq
    FROM {descriptor_values} a WHERE a.server = 1)"""


@query(oracle(f"""
    WITH v AS (SELECT range_id, idx, arg_min(start, seq) AS start, arg_min(stop, seq) AS stop, arg_min(generation, seq) AS generation FROM {{descriptor_values}} GROUP BY range_id, idx),
    g AS (SELECT idx AS gi, node AS holder, first_id, last_id FROM {{grants}} QUALIFY row_number() OVER (PARTITION BY idx ORDER BY seq) = 1),
    p AS (SELECT s.*, v.start, v.stop, v.generation FROM {_SPLIT} s ASOF LEFT JOIN v ON v.range_id = s.range_id AND s.idx > v.idx),
    o AS (SELECT p.*, g.holder, g.last_id, row_number() OVER (PARTITION BY right_id ORDER BY seq) > 1 AS again FROM p ASOF LEFT JOIN g ON p.right_id >= g.first_id),
    w AS (SELECT *, CASE WHEN start IS NULL THEN 'no descriptor' WHEN NOT (left_start = start AND left_stop = split_at AND right_start = split_at AND right_stop = stop) THEN 'spans'
        WHEN NOT (left_generation = generation + 1 AND right_generation = generation + 1) THEN 'generation' WHEN NOT coalesce(last_id >= right_id AND holder = node, false) THEN 'id not granted' WHEN again THEN 'id used again' END AS what FROM o)
    SELECT range_id, idx, what, seq FROM w WHERE what IS NOT NULL
"""))
def chk_split_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = fixture(spark, sf_dir, "descriptor_values")
    split = spark.sql(f"SELECT * FROM {_SPLIT} s", descriptor_values=values)
    return checks.split_lineage(split, values, fixture(spark, sf_dir, "grants"))


@query(oracle("SELECT v.range_id, v.node, v.term, v.seq FROM (SELECT * FROM {votes} WHERE granted) v ASOF LEFT JOIN {replica_states} s ON s.range_id = v.range_id AND s.node = v.node AND v.seq > s.seq WHERE s.what IS NULL OR s.what IN ('removed', 'refused')"))
def chk_placeholder_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.placeholder_votes(fixture(spark, sf_dir, "votes"), fixture(spark, sf_dir, "replica_states"))


_HELD = "(SELECT idx % 3 AS node, range_id, start, stop, seq AS from_seq, lead(seq) OVER (PARTITION BY idx % 3, range_id ORDER BY seq) AS to_seq FROM {meta_updates})"


@query(oracle(f"WITH h AS (SELECT * FROM {_HELD} x) SELECT a.node, a.range_id, min(greatest(a.start, b.start)) AS low, a.from_seq AS seq FROM h a JOIN h b ON a.node = b.node AND a.range_id <> b.range_id AND a.start < b.stop AND b.start < a.stop AND b.from_seq < a.from_seq AND coalesce(b.to_seq, 4611686018427387904) > a.from_seq GROUP BY a.node, a.range_id, a.from_seq"))
def chk_owner_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = valid_until(fixture(spark, sf_dir, "meta_updates").selectExpr("idx % 3 AS node", "range_id", "start", "stop", "seq AS from_seq"), ["node", "range_id"], "from_seq", "to_seq")
    return checks.owner_overlap(held)


@query(oracle("""
    WITH t AS (SELECT *, max(stop) OVER (ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {tiles}),
    k AS (SELECT CASE WHEN reach < start THEN 'gap' WHEN reach > start THEN 'overlap' END AS kind, least(reach, start) AS from_key, CASE WHEN reach < start THEN start ELSE least(reach, stop) END AS until_key FROM t)
    SELECT * FROM k WHERE kind IS NOT NULL UNION ALL SELECT 'gap', -5, min(start) FROM {tiles} HAVING min(start) > -5 UNION ALL SELECT 'gap', max(stop), 200000 FROM {tiles} HAVING max(stop) < 200000
"""))
def chk_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.tiling(fixture(spark, sf_dir, "tiles"), -5, 200000)


@query(oracle("""
    WITH f AS (SELECT * FROM {grants} QUALIFY row_number() OVER (PARTITION BY idx ORDER BY seq) = 1),
    i AS (SELECT seq FROM (SELECT *, max(last_id) OVER (ORDER BY first_id, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f) x WHERE first_id <= reach UNION ALL SELECT seq FROM f WHERE first_id > last_id
          UNION ALL SELECT min(g.seq) FROM {grants} g JOIN f USING (idx) WHERE g.first_id <> f.first_id OR g.last_id <> f.last_id GROUP BY g.idx),
    r AS (SELECT seq FROM (SELECT *, lag(generation) OVER w AS lg, lag(range_id) OVER w AS lr FROM {writes_by_owner} WINDOW w AS (PARTITION BY key ORDER BY seq)) x WHERE generation < lg OR (range_id <> lr AND generation <= lg)),
    v AS (SELECT v.seq FROM (SELECT * FROM {votes} WHERE granted) v ASOF LEFT JOIN {replica_states} s ON s.range_id = v.range_id AND s.node = v.node AND v.seq > s.seq WHERE s.what IS NULL OR s.what IN ('removed', 'refused')),
    a AS (SELECT 'ids_unique' AS check_name, 5 AS place, count(*) AS violations, min(seq) AS first_seq FROM i UNION ALL SELECT 'generations_rise', 2, count(*), min(seq) FROM r UNION ALL SELECT 'placeholder_votes', 7, count(*), min(seq) FROM v)
    SELECT check_name, violations, first_seq, row_number() OVER (ORDER BY violations = 0, place) AS rank FROM a
"""))
def chk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.verdicts({
        "ids_unique": chk_ids_unique(spark, sf_dir),
        "generations_rise": chk_generations_rise(spark, sf_dir),
        "placeholder_votes": chk_placeholder_votes(spark, sf_dir),
    })


@query(oracle("SELECT s.msg_id, count(d.msg_id) AS delivered, min(d.t) - min(s.t) AS first_delay, greatest(count(d.msg_id) - 1, 0) AS duplicates FROM {messages} s LEFT JOIN {deliveries} d ON d.msg_id = s.msg_id GROUP BY s.msg_id"))
def trace_send_deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.send_deliver(fixture(spark, sf_dir, "messages"), fixture(spark, sf_dir, "deliveries"))


@query(oracle("SELECT * FROM {messages} WHERE msg_id NOT IN (SELECT msg_id FROM {deliveries})"))
def trace_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.lost(fixture(spark, sf_dir, "messages"), fixture(spark, sf_dir, "deliveries"))


@query(oracle("SELECT d.msg_id, d.receiver, d.seq FROM {deliveries} d LEFT JOIN (SELECT * FROM {messages} WHERE msg_id % 31 <> 0) s USING (msg_id) WHERE s.msg_id IS NULL OR s.receiver <> d.receiver OR s.seq >= d.seq"))
def trace_unsent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.unsent(fixture(spark, sf_dir, "messages").filter("msg_id % 31 <> 0"), fixture(spark, sf_dir, "deliveries"))


@query(oracle("SELECT event_type AS event, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM {trace} GROUP BY event_type"))
def trace_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.kinds(fixture(spark, sf_dir, "trace").withColumn("event", F.col("event_type")), "event")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "trace").select(F.lit("plain-1").alias("run"), "seq", "t", "node", "range_id", F.col("node").cast("long").alias("server"), F.col("v").alias("idx"), F.col("v").alias("term"))
    return trace.to_lines(rows, "raft_commit")


@query(oracle("SELECT seq, t, node FROM {trace} WHERE range_id = 2"))
def trace_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.carve(_lines(spark, sf_dir), 2).select("seq", "t", "node")


@query(oracle("SELECT seq, t, t AS decided_ns, node, range_id, CAST(node AS BIGINT) AS server, v AS idx, v AS term FROM {trace}"))
def trace_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.scratch(spark, "trace")
    jsonl.write_trace(_lines(spark, sf_dir), path)
    return trace.view(jsonl.read_trace(spark, path), "raft_commit").drop("run")


@query(oracle("SELECT min(seq) AS line, arg_min(event_type, seq) AS recorded, arg_min(event_type, seq) || '!' AS replayed FROM {trace} WHERE seq % 500 = 321"))
def trace_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "trace").select(F.col("seq").alias("line"), F.col("event_type").alias("body"))
    return trace.first_difference(rows, rows.withColumn("body", F.when(F.col("line") % 500 == 321, F.concat("body", F.lit("!"))).otherwise(F.col("body"))))


@query(oracle("SELECT bit_xor(CAST('0x' || substr(md5(seq || ':' || event_type), 1, 15) AS BIGINT)) AS digest, count(*) AS lines FROM {trace}"))
def trace_body_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.body_digest(fixture(spark, sf_dir, "trace").select(F.col("seq").alias("line"), F.col("event_type").alias("body")))


@query(oracle("""
    WITH p AS (SELECT *, coalesce(lag(payload) OVER (PARTITION BY chain ORDER BY seq), '') AS before FROM {audit}),
    d AS (SELECT chain, seq, payload, sha256(CASE WHEN seq % 333 = 100 THEN 'x' ELSE before || payload END) AS digest FROM p),
    q AS (SELECT *, lag(digest) OVER (PARTITION BY chain ORDER BY seq) AS last FROM d)
    SELECT chain, seq FROM q WHERE digest <> sha256(coalesce(last, '') || payload)
"""))
def trace_audit_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    before = F.coalesce(F.lag("payload").over(Window.partitionBy("chain").orderBy("seq")), F.lit(""))
    text = F.when(F.col("seq") % 333 == 100, F.lit("x")).otherwise(F.concat("before", "payload"))
    return trace.audit_breaks(fixture(spark, sf_dir, "audit").withColumn("before", before).select("chain", "seq", "payload", F.sha2(text, 256).alias("digest")))
