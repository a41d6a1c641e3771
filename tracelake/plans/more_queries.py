"""Queries of the remaining trace checks and of the write-ahead-log codec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import valid_until
from ..operators import checks, measure, trace
from ..sources.tables import fixture, with_fixtures
from .registry import query


@query(with_fixtures("SELECT range_id, node, seq FROM (SELECT *, lag(what) OVER (PARTITION BY range_id, node ORDER BY seq) AS before FROM {replica_states}) s WHERE what = 'created' AND before = 'created'"))
def chk_created_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.created_twice(fixture(spark, sf_dir, "replica_states"))


_APPLIED_SPLITS = "(SELECT node, v % 6 AS right_id, seq FROM {trace} WHERE event_type = 'purchase' AND seq % 11 = 0)"


@query(with_fixtures(f"SELECT node, right_id, seq FROM {_APPLIED_SPLITS} s WHERE NOT EXISTS (SELECT 1 FROM {{replica_states}} r WHERE r.what = 'created' AND r.range_id = s.right_id AND r.node = s.node)"))
def chk_right_half_owed(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = fixture(spark, sf_dir, "trace").filter("event_type = 'purchase' and seq % 11 = 0").selectExpr("node", "v % 6 AS right_id", "seq")
    return checks.right_half_owed(splits, fixture(spark, sf_dir, "replica_states"))


_HELD = "(SELECT idx % 3 AS node, range_id, start, stop, seq AS from_seq, lead(seq) OVER (PARTITION BY idx % 3, range_id ORDER BY seq) AS to_seq FROM {meta_updates})"


@query(with_fixtures(f"""
    WITH i AS (SELECT seq % 3 AS node, 1 + user_id AS range_id, user_id * 10 + v % 40 AS start, user_id * 10 + v % 40 + 3 AS stop, seq FROM {{trace}} WHERE event_type = 'click'), h AS (SELECT * FROM {_HELD} x)
    SELECT i.node, i.range_id, i.seq, min(h.range_id) AS holder FROM i JOIN h ON h.node = i.node AND h.range_id <> i.range_id AND h.start < i.stop AND i.start < h.stop AND h.from_seq < i.seq AND coalesce(h.to_seq, 4611686018427387904) > i.seq GROUP BY i.node, i.range_id, i.seq
"""))
def chk_install_over_another(spark: SparkSession, sf_dir: str) -> DataFrame:
    installs = fixture(spark, sf_dir, "trace").filter("event_type = 'click'").selectExpr("seq % 3 AS node", "1 + user_id AS range_id", "user_id * 10 + v % 40 AS start", "user_id * 10 + v % 40 + 3 AS stop", "seq")
    held = valid_until(fixture(spark, sf_dir, "meta_updates").selectExpr("idx % 3 AS node", "range_id", "start", "stop", "seq AS from_seq"), ["node", "range_id"], "from_seq", "to_seq")
    return checks.install_over_another(installs, held)


@query(with_fixtures("SELECT user_id % 7 AS epoch, seq FROM {trace} w WHERE seq % 17 = 3 AND NOT EXISTS (SELECT 1 FROM {outages} f WHERE w.t BETWEEN f.from_t AND f.until_t)"))
def chk_recovery_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = fixture(spark, sf_dir, "trace").selectExpr("user_id % 7 AS epoch", "seq", "t")
    return checks.recovery_losses(writes, writes.filter("seq % 17 <> 3").select("epoch", "seq"), fixture(spark, sf_dir, "outages"))


@query(with_fixtures("""
    WITH RECURSIVE f AS (SELECT CAST(floor(seq / 100) AS BIGINT) AS number, min(seq) AS first_seq, max(seq) AS max_seq FROM {trace} GROUP BY ALL),
    c AS (SELECT number AS input, 1000000 + CAST(floor(number / 4) AS BIGINT) AS output FROM f UNION ALL SELECT DISTINCT 1000000 + CAST(floor(number / 4) AS BIGINT), 2000000 FROM f WHERE number < 8),
    walk(number, now_at, depth) AS (SELECT number, number, 0 FROM f UNION ALL SELECT w.number, c.output, w.depth + 1 FROM walk w JOIN c ON c.input = w.now_at),
    l AS (SELECT number, max_by(now_at, depth) AS table_number FROM walk GROUP BY number)
    SELECT t.seq, l.table_number FROM {trace} t JOIN f ON t.seq BETWEEN f.first_seq AND f.max_seq JOIN l USING (number)
"""))
def kv_table_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = fixture(spark, sf_dir, "trace").select("seq")
    flushes = writes.groupBy(F.floor(F.col("seq") / 100).alias("number")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("max_seq"))
    second = (F.lit(1000000) + F.floor(F.col("number") / 4)).cast("long")
    compactions = flushes.select(F.col("number").alias("input"), second.alias("output")).unionByName(flushes.filter("number < 8").select(second.alias("input"), F.lit(2000000).cast("long").alias("output")).distinct())
    return checks.table_of_writes(writes, flushes, compactions)


@query(with_fixtures("""
    WITH b AS (SELECT 'run-' || range_id AS run, string_agg(event_type || chr(10), '' ORDER BY seq) AS body FROM {trace} GROUP BY range_id)
    SELECT run, lpad(lower(to_hex(CAST(list_reduce(list_transform(string_split(body, ''), lambda c: CAST(ascii(c) AS HUGEINT)), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT)) AS UBIGINT))), 16, '0') AS hash FROM b
"""))
def trace_fnv_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "trace").select(F.concat(F.lit("run-"), F.col("range_id")).alias("run"), F.col("seq").alias("line"), F.col("event_type").alias("body"))
    return trace.fnv_body(rows)


# each meta index is applied three times, and some come late
_META_APPLIES = "(SELECT m.seq * 10 + s.server * 40 AS seq, m.idx, m.t + s.server * 100000 AS t, m.range_id, m.start, m.stop FROM {meta_updates} m, (SELECT CAST(r_regionkey + 1 AS BIGINT) AS server FROM {region} WHERE r_regionkey < 3) s)"
_ARMS = "(SELECT range_id AS arm, range_id, max(stop) AS first_cut, CASE WHEN min(stop) < max(stop) THEN min(stop) END AS second_cut, min(t) + 500000 AS since FROM {meta_updates} GROUP BY range_id)"


@query(with_fixtures(f"""
    WITH a AS {_META_APPLIES}, lines AS (SELECT DISTINCT seq, idx FROM a), up AS (SELECT seq, idx FROM (SELECT seq, idx, max(idx) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM lines) w WHERE high IS NULL OR idx > high),
    k AS (SELECT a.* FROM a JOIN up ON up.seq = a.seq AND up.idx = a.idx), arms AS {_ARMS},
    s AS (SELECT arm, seq, idx, t, row_number() OVER (PARTITION BY arm ORDER BY seq) AS place FROM arms JOIN k ON (k.range_id = arms.range_id AND k.stop = second_cut) OR (k.start = second_cut AND k.stop = first_cut))
    SELECT arms.arm, CASE WHEN s.t >= since THEN s.t - since END AS second_applied, EXISTS (SELECT 1 FROM k WHERE k.range_id = arms.range_id AND k.stop = arms.first_cut AND k.seq > s.seq) AS reordered FROM arms LEFT JOIN s ON s.arm = arms.arm AND s.place = 1
"""))
def m_meta_reorders(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates, region = fixture(spark, sf_dir, "meta_updates"), fixture(spark, sf_dir, "region")
    servers = region.filter("r_regionkey < 3").selectExpr("CAST(r_regionkey + 1 AS BIGINT) AS server")
    applies = updates.crossJoin(F.broadcast(servers)).selectExpr("seq * 10 + server * 40 AS seq", "idx", "t + server * 100000 AS t", "range_id", "start", "stop")  # three rows
    cuts = updates.groupBy("range_id").agg(F.max("stop").alias("first_cut"), F.min("stop").alias("least"), (F.min("t") + 500000).alias("since"))
    arms = cuts.select(F.col("range_id").alias("arm"), "range_id", "first_cut", F.when(F.col("least") < F.col("first_cut"), F.col("least")).alias("second_cut"), "since")
    return measure.meta_reorders(applies, arms)


_REFUSALS = "(SELECT seq, range_id, (user_id % 6) * 4294967296 + v % 4 AS client, CASE seq % 3 WHEN 0 THEN 'apply' WHEN 1 THEN 'read' ELSE 'receipt' END AS place FROM {trace} WHERE event_type = 'view')"
_SPLITS = "(SELECT range_id, seq FROM {trace} WHERE event_type = 'purchase' AND range_id <> 2 AND seq > 300)"


@query(with_fixtures(f"""
    WITH r AS {_REFUSALS}, s AS {_SPLITS}, k AS (SELECT *, client // 4294967296 AS hi, client % 4294967296 AS lo FROM r)
    SELECT count(*) FILTER (WHERE hi = 5 AND place = 'apply' AND lo = 0) AS writes_refused_at_apply, count(*) FILTER (WHERE hi = 5 AND place = 'read' AND lo = 0) AS gets_refused_at_serving,
           count(*) FILTER (WHERE hi = 5 AND place = 'receipt' AND lo IN (2, 3)) AS stale_reads_refused, count(*) FILTER (WHERE hi IN (1, 2, 3) AND EXISTS (SELECT 1 FROM s WHERE s.range_id = k.range_id AND s.seq < k.seq)) AS clients_mismatched_by_a_split FROM k
"""))
def m_refusal_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = fixture(spark, sf_dir, "trace")
    place = "CASE seq % 3 WHEN 0 THEN 'apply' WHEN 1 THEN 'read' ELSE 'receipt' END AS place"
    refusals = views.filter("event_type = 'view'").selectExpr("seq", "range_id", "(user_id % 6) * 4294967296 + v % 4 AS client", place)
    return measure.refusal_shapes(refusals, views.filter("event_type = 'purchase' and range_id <> 2 and seq > 300").select("range_id", "seq"), load=5, writer=1, reader=2, clients=3)


@query(with_fixtures("""
    WITH p AS (SELECT idx, range_id, server, seq, idx % 5 AS request FROM {appends} WHERE idx % 2 = 0), s AS (SELECT range_id, idx, seq + 1 AS seq FROM {appends} WHERE server = 2 AND idx % 3 = 0)
    SELECT count(*) AS splits FROM (SELECT DISTINCT range_id, idx FROM s WHERE EXISTS (SELECT 1 FROM p WHERE p.range_id = s.range_id AND p.idx = s.idx AND p.seq < s.seq AND ((server = 1 AND request = 2) OR (server = 3 AND request = 4) OR (server = 2 AND request = 0)))) x
"""))
def m_splits_from_restarted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    appends = fixture(spark, sf_dir, "appends")
    arms = spark.createDataFrame([(1, 2), (3, 4), (2, 0)], "victim long, request long")
    proposals = appends.filter("idx % 2 = 0").selectExpr("server", "range_id", "idx", "idx % 5 AS request", "seq")
    return measure.splits_from_restarted_nodes(appends.filter("server = 2 and idx % 3 = 0").selectExpr("range_id", "idx", "seq + 1 AS seq"), proposals, arms)


@query(with_fixtures("""
    SELECT o.o_orderkey AS ask, (SELECT min(s.idx) FROM {splits} s WHERE s.range_id = 1 + o.o_orderkey % 10 AND s.split_at = o.o_custkey) AS applied,
           (SELECT min(d.arrival) FROM {descriptors} d WHERE 1 + d.range_id % 10 = 1 + o.o_orderkey % 10 AND NOT (d.start < o.o_custkey AND o.o_custkey < d.stop)) AS outside FROM {orders} o
"""))
def m_split_fate(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fixture(spark, sf_dir, "orders").selectExpr("o_orderkey AS ask", "1 + o_orderkey % 10 AS range_id", "o_custkey AS cut")
    spans = fixture(spark, sf_dir, "descriptors").selectExpr("1 + range_id % 10 AS range_id", "start", "stop", "arrival AS t")
    return measure.split_fate(asked, fixture(spark, sf_dir, "splits").selectExpr("range_id", "split_at", "idx AS t"), spans)
