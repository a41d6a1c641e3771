"""Queries of the command log and the range layer over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals, scalar
from ..operators import log, ranges
from ..sources.tables import fixture, with_fixtures
from .registry import query


def oracle(sql: str) -> str:
    return with_fixtures(sql)


@query(oracle("SELECT range_id, key, idx, value FROM (SELECT * FROM {commands} WHERE kind IN ('put', 'delete') QUALIFY row_number() OVER (PARTITION BY range_id, key ORDER BY idx DESC) = 1) w WHERE kind = 'put'"))
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.replay_puts(fixture(spark, sf_dir, "commands"))


@query(oracle("""
    WITH RECURSIVE c AS (SELECT range_id, key, idx, kind, value, expect, row_number() OVER (PARTITION BY range_id, key ORDER BY idx) AS rn FROM {commands}),
    r AS (SELECT range_id, key, idx, kind, rn, CASE WHEN kind = 'cas' THEN expect IS NULL END AS swapped, CAST(NULL AS BIGINT) AS read_value,
              CASE WHEN kind = 'put' OR (kind = 'cas' AND expect IS NULL) THEN value END AS after FROM c WHERE rn = 1
          UNION ALL
          SELECT c.range_id, c.key, c.idx, c.kind, c.rn, CASE WHEN c.kind = 'cas' THEN r.after IS NOT DISTINCT FROM c.expect END, CASE WHEN c.kind = 'get' THEN r.after END,
              CASE WHEN c.kind = 'put' THEN c.value WHEN c.kind = 'delete' THEN NULL WHEN c.kind = 'cas' AND r.after IS NOT DISTINCT FROM c.expect THEN c.value ELSE r.after END
          FROM r JOIN c ON c.range_id = r.range_id AND c.key = r.key AND c.rn = r.rn + 1)
    SELECT range_id, key, idx, kind, CASE kind WHEN 'cas' THEN 'swapped' WHEN 'get' THEN 'value' WHEN 'noop' THEN 'noop' ELSE 'done' END AS outcome, swapped, read_value AS held FROM r
"""))
def log_cas_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.cas_outcomes(fixture(spark, sf_dir, "commands"))


@query(oracle("SELECT range_id, client, client_seq, min(idx) AS idx, count(*) AS sent FROM {commands} GROUP BY ALL"))
def log_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.dedup_requests(fixture(spark, sf_dir, "commands"))


@query(oracle("""
    WITH g AS (SELECT range_id, term, count(DISTINCT node) FILTER (WHERE granted) AS granted, count(DISTINCT node) FILTER (WHERE granted AND node IN (1, 2, 3)) AS ours FROM {votes} GROUP BY ALL)
    SELECT range_id, term, granted, ours * 2 > 3 AS won FROM g
"""))
def quorum_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.grants_by_majority(fixture(spark, sf_dir, "votes"), [1, 2, 3])


_REACHED = "(SELECT coalesce(list_sort(list(coalesce(m.match_index, 0)))[{1}], 0) FROM (SELECT unnest([{0}]) AS s) v LEFT JOIN {{matches}} m ON m.server = v.s AND m.range_id = r.range_id)"


@query(oracle(f"SELECT range_id, {_REACHED.format('1, 2, 3', 2)} AS commit_index FROM (SELECT DISTINCT range_id FROM {{matches}}) r"))
def commit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.commit_indices(fixture(spark, sf_dir, "matches"), [1, 2, 3])


@query(oracle(f"SELECT range_id, least({_REACHED.format('1, 2, 3', 2)}, {_REACHED.format('2, 3, 4, 5', 2)}) AS commit_index FROM (SELECT DISTINCT range_id FROM {{matches}}) r"))
def commit_index_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.commit_indices(fixture(spark, sf_dir, "matches"), [1, 2, 3], [2, 3, 4, 5])


@query(oracle("SELECT range_id, server, idx, term FROM {appends} e WHERE NOT EXISTS (SELECT 1 FROM {truncates} c WHERE c.range_id = e.range_id AND c.server = e.server AND c.seq > e.seq AND c.from_idx <= e.idx)"))
def log_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = fixture(spark, sf_dir, "appends").select("range_id", "server", "idx", "term", "seq")
    return log.truncations(entries, fixture(spark, sf_dir, "truncates").drop("t")).select("range_id", "server", "idx", "term")


@query(oracle("SELECT node, least(coalesce(p[2] + 500, 0), 1000000) AS lease_end FROM (SELECT node, list_sort(list(seq), 'DESC') AS p FROM (SELECT node, seq FROM {votes} WHERE granted QUALIFY row_number() OVER (PARTITION BY node ORDER BY seq DESC) <= 3) v GROUP BY node) g"))
def lease_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    last = fixture(spark, sf_dir, "votes").filter("granted").withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("seq")))).filter("k <= 3")
    voters = F.array(F.lit(7), F.lit(8), F.lit(9))
    found = last.groupBy("node").agg(F.collect_list("seq").alias("p")).select("node", scalar.lease_end(F.col("p"), voters, F.lit(1), F.lit(500)).cast("long").alias("lease_end"))
    return found.select("node", F.least("lease_end", F.lit(1000000).cast("long")).alias("lease_end"))


_OWNED = """WITH b AS (SELECT DISTINCT low FROM (SELECT start AS low FROM {descriptors} UNION ALL SELECT stop FROM {descriptors}) x),
    e AS (SELECT low, lead(low) OVER (ORDER BY low) AS high FROM b),
    o AS (SELECT e.low, e.high, d.range_id, d.generation FROM e JOIN {descriptors} d ON e.low >= d.start AND e.low < d.stop AND d.start < d.stop WHERE e.high IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY e.low ORDER BY d.generation DESC, d.arrival) = 1)"""


@query(oracle(_OWNED + " SELECT low, high, range_id, generation FROM o"))
def range_merge_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.merge_generation(fixture(spark, sf_dir, "descriptors"))


@query(oracle(_OWNED + ", f AS (SELECT *, CASE WHEN lag(high) OVER w = low AND lag(range_id) OVER w = range_id AND lag(generation) OVER w = generation THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (ORDER BY low)), g AS (SELECT *, sum(fresh) OVER (ORDER BY low) AS island FROM f) SELECT range_id, generation, min(low) AS low, max(high) AS high FROM g GROUP BY island, range_id, generation"))
def range_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.coalesce_intervals(ranges.merge_generation(fixture(spark, sf_dir, "descriptors")))


@query(oracle(_OWNED + " SELECT k.o_orderkey, k.o_custkey AS key, o.range_id, o.generation FROM {orders} k LEFT JOIN o ON k.o_custkey >= o.low AND k.o_custkey < o.high"))
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fixture(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return ranges.lookup(keys, ranges.merge_generation(fixture(spark, sf_dir, "descriptors")))


@query(oracle("SELECT k.o_orderkey, k.o_custkey AS key, d.range_id, d.generation FROM {orders} k JOIN {descriptors} d ON k.o_custkey >= d.start AND k.o_custkey < d.stop WHERE d.arrival >= 0"))
def range_join_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fixture(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    spans = fixture(spark, sf_dir, "descriptors").filter("arrival >= 0").select("range_id", "start", "stop", "generation")
    return ranges.bucketed_lookup(keys, spans, 64).select("o_orderkey", "key", "range_id", "generation")


@query(oracle("""
    WITH q AS (SELECT o_orderkey AS request, o_custkey AS key, 1 + o_orderkey % 10 AS range_id FROM {orders}),
    j AS (SELECT q.*, CASE WHEN q.key >= d.start AND q.key < d.stop AND d.state <> 'subsumed' THEN 'applied' ELSE 'out_of_span' END AS verdict FROM q LEFT JOIN {descriptors} d ON d.range_id = q.range_id)
    SELECT request, range_id, key, verdict, CASE WHEN verdict = 'applied' THEN '' ELSE coalesce((SELECT string_agg(CAST(h AS STRING), ',' ORDER BY h) FROM (SELECT DISTINCT d.range_id AS h FROM {descriptors} d WHERE j.key >= d.start AND j.key < d.stop) x), '') END AS holders FROM j
"""))
def range_route_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = fixture(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 10 + 1).alias("range_id"))
    return ranges.route(requests, fixture(spark, sf_dir, "descriptors"))


def _map_sql(name: str, where: str) -> str:
    return f"""{name}_b AS (SELECT DISTINCT low FROM (SELECT start AS low FROM {{descriptors}} WHERE {where} UNION ALL SELECT stop FROM {{descriptors}} WHERE {where}) x),
    {name}_e AS (SELECT low, lead(low) OVER (ORDER BY low) AS high FROM {name}_b),
    {name} AS (SELECT e.low, e.high, d.range_id, d.generation FROM {name}_e e JOIN {{descriptors}} d ON e.low >= d.start AND e.low < d.stop AND ({where}) WHERE e.high IS NOT NULL QUALIFY row_number() OVER (PARTITION BY e.low ORDER BY d.generation DESC, d.arrival) = 1)"""


@query(oracle(f"""
    WITH {_map_sql('m0', 'arrival < 0')}, {_map_sql('m1', 'true')},
    c AS (SELECT low, lead(low) OVER (ORDER BY low) AS high FROM (SELECT low FROM m0 UNION SELECT high FROM m0 UNION SELECT low FROM m1 UNION SELECT high FROM m1) u)
    SELECT c.low, c.high, m0.range_id AS old_range, m0.generation AS old_generation, m1.range_id AS new_range, m1.generation AS new_generation
    FROM c LEFT JOIN m0 ON c.low >= m0.low AND c.low < m0.high LEFT JOIN m1 ON c.low >= m1.low AND c.low < m1.high
    WHERE c.high IS NOT NULL AND (m0.range_id IS DISTINCT FROM m1.range_id OR m0.generation IS DISTINCT FROM m1.generation)
"""))
def range_meta_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    descriptors = fixture(spark, sf_dir, "descriptors")
    return ranges.meta_diff(ranges.merge_generation(descriptors.filter("arrival < 0")), ranges.merge_generation(descriptors))


@query(oracle("""
    WITH l AS (SELECT r.r_regionkey AS client, d.* FROM {descriptors} d JOIN {region} r ON d.range_id % 5 = r.r_regionkey OR d.arrival < 0),
    b AS (SELECT DISTINCT client, low FROM (SELECT client, start AS low FROM l UNION ALL SELECT client, stop FROM l) x),
    e AS (SELECT client, low, lead(low) OVER (PARTITION BY client ORDER BY low) AS high FROM b)
    SELECT e.client, e.low, e.high, l.range_id, l.generation FROM e JOIN l ON l.client = e.client AND e.low >= l.start AND e.low < l.stop WHERE e.high IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY e.client, e.low ORDER BY l.generation DESC, l.arrival) = 1
"""))
def range_cache_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = fixture(spark, sf_dir, "region").select(F.col("r_regionkey").alias("client"))
    descriptors = fixture(spark, sf_dir, "descriptors")
    learned = descriptors.join(F.broadcast(clients), (descriptors["range_id"] % 5 == clients["client"]) | (descriptors["arrival"] < 0))  # the five regions
    return ranges.merge_generation(learned, ("client",))


_SPLITS = "SELECT s.idx, s.range_id, s.split_at, s.right_id, CASE WHEN s.range_id = 1 THEN 'system' WHEN NOT coalesce(s.split_at > d.start AND s.split_at < d.stop, false) THEN 'outside' WHEN d.state <> 'live' THEN 'not_live' WHEN s.joint THEN 'joint' WHEN s.right_id IS NULL THEN 'no_id' END AS refusal, d.start, d.stop, d.generation FROM {splits} s LEFT JOIN {descriptors} d USING (range_id)"


@query(oracle(_SPLITS))
def range_split_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.split_refusals(fixture(spark, sf_dir, "splits"), fixture(spark, sf_dir, "descriptors"))


@query(oracle(f"WITH g AS (SELECT * FROM ({_SPLITS}) s WHERE refusal IS NULL) SELECT idx, range_id, start, split_at AS stop, generation + 1 AS generation FROM g UNION ALL SELECT idx, right_id, split_at, stop, generation + 1 FROM g"))
def range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.split_once(fixture(spark, sf_dir, "splits"), fixture(spark, sf_dir, "descriptors"))


@query(oracle("""
    WITH g AS (SELECT s.range_id AS root, s.idx, s.split_at, s.right_id, d.start, d.stop FROM {splits} s JOIN {descriptors} d USING (range_id) WHERE NOT s.joint AND s.right_id IS NOT NULL AND s.split_at > d.start AND s.split_at < d.stop AND d.state = 'live'),
    p AS (SELECT root, split_at, min_by(right_id, idx) AS right_id, min(idx) AS idx FROM g GROUP BY root, split_at),
    c AS (SELECT range_id AS root, start AS split_at, range_id AS right_id, CAST(-1 AS BIGINT) AS idx, start, stop, generation FROM {descriptors} WHERE arrival = -1 UNION ALL SELECT p.root, p.split_at, p.right_id, p.idx, d.start, d.stop, d.generation FROM p JOIN {descriptors} d ON d.range_id = p.root),
    e AS (SELECT *, lead(split_at, 1, stop) OVER (PARTITION BY root ORDER BY split_at) AS upto FROM c)
    SELECT root, right_id AS range_id, split_at AS start, upto AS stop, generation AS generation FROM e
"""))
def range_split_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    descriptors = fixture(spark, sf_dir, "descriptors").filter("arrival = -1")
    base = descriptors.select(F.col("range_id").alias("root"), F.col("generation").alias("first"))
    found = ranges.split_lineage(fixture(spark, sf_dir, "splits"), descriptors)
    return found.join(base, "root").select("root", "range_id", "start", "stop", F.col("first").alias("generation"))


@query(oracle("SELECT idx, node, CAST(sum(size) OVER (ORDER BY idx) AS BIGINT) - size + 1 AS first_id, CAST(sum(size) OVER (ORDER BY idx) AS BIGINT) AS last_id FROM {leases}"))
def range_id_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.id_blocks(fixture(spark, sf_dir, "leases"))


_TILES = "SELECT kind, from_key, until_key FROM (SELECT CASE WHEN reach < start THEN 'gap' WHEN reach > start THEN 'overlap' END AS kind, least(reach, start) AS from_key, CASE WHEN reach < start THEN start ELSE least(reach, stop) END AS until_key FROM (SELECT *, max(stop) OVER (ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {tiles}) t) k WHERE kind = '%s'"


@query(oracle(_TILES % "gap"))
def range_tiling_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps_and_overlaps(fixture(spark, sf_dir, "tiles"), []).filter("kind = 'gap'")


@query(oracle(_TILES % "overlap"))
def range_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps_and_overlaps(fixture(spark, sf_dir, "tiles"), []).filter("kind = 'overlap'")


_FORCE = "SELECT p.range_id, p.idx, p.key, v.start, v.stop, v.generation FROM (SELECT * FROM {{served}}) p ASOF LEFT JOIN (SELECT range_id, idx, min(start) AS start, min(stop) AS stop, min(generation) AS generation FROM {{descriptor_values}} WHERE idx <> 400 GROUP BY range_id, idx) v ON p.range_id = v.range_id AND p.idx {0} v.idx"


def _forced(spark: SparkSession, sf_dir: str, inclusive: bool) -> DataFrame:
    values = fixture(spark, sf_dir, "descriptor_values").filter("idx <> 400").groupBy("range_id", "idx").agg(F.min("start").alias("start"), F.min("stop").alias("stop"), F.min("generation").alias("generation"))
    found = ranges.in_force(fixture(spark, sf_dir, "served").select("range_id", "idx", "key"), values, inclusive)
    return found.select("range_id", "idx", "key", "found.start", "found.stop", "found.generation")


@query(oracle(_FORCE.format(">=").replace("{{", "{").replace("}}", "}")))
def range_descriptor_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forced(spark, sf_dir, True)


@query(oracle(_FORCE.format(">").replace("{{", "{").replace("}}", "}")))
def range_descriptor_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forced(spark, sf_dir, False)


@query(oracle("SELECT l.range_id AS left_id, r.range_id AS right_id, l.start, l.stop AS edge, r.stop, greatest(l.generation, r.generation) + 1 AS generation FROM {descriptors} l JOIN {descriptors} r ON l.stop = r.start WHERE l.state = 'live' AND r.state = 'live' AND l.range_id <> r.range_id"))
def range_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.merge_candidates(fixture(spark, sf_dir, "descriptors"))


@query(oracle("""
    WITH p AS (SELECT DISTINCT CAST(s_suppkey AS BIGINT) AS range_id, s_nationkey AS node FROM {supplier}), n AS (SELECT node, count(*) AS n FROM p GROUP BY node),
    f AS (SELECT node FROM n ORDER BY n DESC, node LIMIT 1), t AS (SELECT node FROM n ORDER BY n, node LIMIT 1)
    SELECT f.node AS from_node, t.node AS to_node, min(p.range_id) AS range_id FROM p JOIN f ON p.node = f.node, t
    WHERE (SELECT max(n) FROM n) > (SELECT avg(n) FROM n) * 1.1 AND (SELECT max(n) - min(n) FROM n) > 1 AND p.range_id NOT IN (SELECT range_id FROM p p2 WHERE p2.node = t.node) GROUP BY ALL
""".replace("{supplier}", "supplier")))
def range_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return ranges.rebalance_move(suppliers.select(F.col("s_suppkey").cast("long").alias("range_id"), F.col("s_nationkey").alias("node")).distinct())


@query(oracle("SELECT node, max(generation) AS generation FROM (SELECT CAST(n_regionkey AS INT) AS node, n_nationkey AS generation, n_nationkey % 4 = 0 AS lost FROM {nation}) d WHERE NOT lost GROUP BY node"))
def range_reseed_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.reseed_pick(fixture(spark, sf_dir, "nation").selectExpr("n_regionkey AS node", "n_nationkey AS generation", "n_nationkey % 4 = 0 AS lost"))


@query()
def range_outbox_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = fixture(spark, sf_dir, "messages").selectExpr("receiver AS peer", "CAST(floor(seq / 100) AS BIGINT) AS flush", "sender AS range_id", "seq", "40 + msg_id % 25 AS bytes")
    return ranges.frame_sizes(ranges.outbox_frames(messages, 400))


@query("""
    WITH c AS (SELECT string_agg(concat_ws('|', n_nationkey, n_name, n_regionkey), chr(10) ORDER BY concat_ws('|', n_nationkey, n_name, n_regionkey)) AS body, count(*) AS n FROM nation)
    SELECT xor(list_reduce(list_transform(string_split(body, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, 2197175160 * (x & 1))), CAST(4294967295 AS BIGINT)), 4294967295) AS digest, n AS rows FROM c
""")
def range_config_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.config_digest(fixture(spark, sf_dir, "nation"))


@query("SELECT n_nationkey, xor(list_reduce(list_transform(string_split(n_name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, 2197175160 * (x & 1))), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM nation")
def scalar_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "nation").select("n_nationkey", scalar.crc32c(F.encode("n_name", "UTF-8")).alias("crc"))


@query("SELECT n_nationkey, lpad(lower(to_hex(CAST(list_reduce(list_transform(string_split(n_name, ''), lambda c: CAST(ascii(c) AS HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT)) AS UBIGINT))), 16, '0') AS fnv FROM nation")
def scalar_fnv1a64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "nation").select("n_nationkey", scalar.fnv1a64(F.encode("n_name", "UTF-8")).alias("fnv"))


@query(oracle("SELECT key, seq, row_number() OVER (ORDER BY key, seq DESC) AS place FROM {log} WHERE seq <= 500"))
def scalar_ikey_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    few = fixture(spark, sf_dir, "log").filter("seq <= 500").withColumn("ikey", scalar.ikey_encode(F.encode("key", "UTF-8"), F.col("seq")))
    return few.select("key", "seq", F.row_number().over(Window.orderBy("ikey")).cast("long").alias("place"))
