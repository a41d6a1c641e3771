"""Queries of the versioned key-value store over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kv
from ..sources import store
from ..sources.tables import fixture, with_fixtures
from .registry import query


def _at(log: DataFrame, share: float) -> Column:
    """The version at that share of the log, pinned by one aggregate."""
    return log.agg(F.floor(F.max("seq") * share).cast("long")).scalar()


VERSION = "(SELECT CAST(floor(max(seq) * {0}) AS BIGINT) FROM {{log}})"
V7, V5, V6 = VERSION.format(0.7), VERSION.format(0.5), VERSION.format(0.6)
NEWEST = "SELECT * FROM {{log}} WHERE seq <= {0} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, ord DESC) = 1"


def oracle(sql: str) -> str:
    return with_fixtures(sql)


@query(oracle("SELECT max(seq) AS version FROM {log}"))
def kv_snapshot_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.snapshot_version(fixture(spark, sf_dir, "log"))


@query(oracle("SELECT key, arg_max(seq, seq) AS seq, arg_max(value, seq) AS value FROM {log} WHERE key = '000000000007' GROUP BY key HAVING arg_max(op, seq) <> 'delete'"))
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.get_at(fixture(spark, sf_dir, "log"), "000000000007")


@query(oracle(f"SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM {{log}} WHERE key = '000000000003' AND seq <= {V5} GROUP BY key HAVING arg_max(op, seq) <> 'delete'"))
def kv_get_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    return kv.get_at(log, "000000000003", _at(log, 0.5))


@query(oracle(f"SELECT key, seq, value FROM ({NEWEST.format(V7)}) n WHERE op <> 'delete'"))
def kv_scan_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    return kv.scan_at(log, _at(log, 0.7))


@query(oracle(f"SELECT key, seq, value FROM ({NEWEST.format(V7)}) n WHERE op <> 'delete' AND key >= '000000000003' AND key < '000000000100' ORDER BY key LIMIT 7"))
def kv_seek_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    return kv.seek(log, 7, _at(log, 0.7), "000000000003", "000000000100")


@query(oracle(f"SELECT key, seq FROM ({NEWEST.format(V7)}) n WHERE op = 'delete'"))
def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    return kv.tombstones(log, _at(log, 0.7))


@query(oracle("SELECT key, seq, value FROM (SELECT * FROM {batched_log} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, ord DESC) = 1) n WHERE op <> 'delete'"))
def kv_batch_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan_at(fixture(spark, sf_dir, "batched_log"))


@query(oracle("SELECT key, seq, value FROM (SELECT * FROM {log} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) n WHERE op <> 'delete'"))
def kv_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    return kv.scan_at(kv.merge_sources(log.filter("seq % 3 = 0"), log.filter("seq % 3 = 1"), log.filter("seq % 3 = 2")))


@query(oracle("SELECT key, seq, value FROM (SELECT * FROM (SELECT * FROM {log} UNION ALL SELECT key, (SELECT max(seq) + 1 FROM {log}), ord, op, value FROM {repairs}) a QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, ord DESC) = 1) n WHERE op <> 'delete'"))
def kv_append_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan_at(kv.append_batch(fixture(spark, sf_dir, "log"), fixture(spark, sf_dir, "repairs")))


IN_SPAN = "EXISTS (SELECT 1 FROM {spans} s WHERE l.key >= s.start AND l.key < s.stop)"
LEFT = f"SELECT * FROM {{log}} l WHERE NOT (seq < {V6} AND {IN_SPAN})"
BROUGHT = f"SELECT key, {V6} AS seq, 0 AS ord, op, value FROM (SELECT * FROM {{other_log}} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) l WHERE op <> 'delete' AND {IN_SPAN}"
REPAIRED = f"SELECT key, {V6} + 1 AS seq, ord, op, value FROM {{repairs}}"


def _live(parts: str, version: str | None = None) -> str:
    bound = f"WHERE seq <= {version}" if version else ""
    return f"SELECT key, seq, value FROM (SELECT * FROM ({parts}) a {bound} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, ord DESC) = 1) n WHERE op <> 'delete'"


@query(oracle(_live(LEFT)))
def kv_delete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    return kv.scan_at(kv.delete_ranges(log, fixture(spark, sf_dir, "spans"), _at(log, 0.6)))


@query(oracle(_live(f"{LEFT} UNION ALL {BROUGHT}")))
def kv_install_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    return kv.scan_at(kv.install_spans(log, fixture(spark, sf_dir, "spans"), fixture(spark, sf_dir, "other_log"), _at(log, 0.6)))


@query(oracle(_live(f"{LEFT} UNION ALL {BROUGHT} UNION ALL {REPAIRED}")))
def kv_install_with_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    return kv.scan_at(kv.install_spans(log, fixture(spark, sf_dir, "spans"), fixture(spark, sf_dir, "other_log"), _at(log, 0.6), fixture(spark, sf_dir, "repairs")))


@query(oracle(_live(f"{LEFT} UNION ALL {BROUGHT}", V5)))
def kv_read_before_install(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    return kv.scan_at(kv.install_spans(log, fixture(spark, sf_dir, "spans"), fixture(spark, sf_dir, "other_log"), _at(log, 0.6)), _at(log, 0.5))


@query(oracle("SELECT CASE WHEN start >= stop THEN 'empty' ELSE 'overlap' END AS refusal, start FROM (SELECT *, max(stop) OVER (ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {spans}) s WHERE start >= stop OR b > start UNION ALL SELECT 'outside', key FROM {repairs} l WHERE NOT " + IN_SPAN))
def kv_install_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.check_spans(fixture(spark, sf_dir, "spans"), fixture(spark, sf_dir, "repairs"))


COMPACTED = f"""SELECT key, seq, ord, op, value, CASE WHEN newer <= {V5} THEN 'dropped_version'
    WHEN newer IS NULL AND op = 'delete' AND seq <= {V5} AND NOT EXISTS (SELECT 1 FROM {{tables}} t WHERE t.level > 3 AND CAST(l.key AS BIGINT) BETWEEN t.first_key % 40 AND t.first_key % 40 + 5) THEN 'dropped_tombstone' ELSE 'kept' END AS verdict
    FROM (SELECT *, lead(seq) OVER (PARTITION BY key ORDER BY seq, ord) AS newer FROM {{log}}) l"""


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    low = F.col("first_key") % 40
    deeper = fixture(spark, sf_dir, "tables").filter("level > 3").select(F.lpad(low.cast("string"), 12, "0").alias("first_key"), F.lpad((low + 5).cast("string"), 12, "0").alias("last_key"))
    return kv.compact(log, _at(log, 0.5), deeper)


@query(oracle(f"SELECT key, seq, ord, op, value FROM ({COMPACTED}) c WHERE verdict = 'kept'"))
def kv_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(spark, sf_dir).filter("verdict = 'kept'").drop("verdict")


@query(oracle(f"SELECT count(*) FILTER (WHERE verdict = 'kept') AS kept, count(*) FILTER (WHERE verdict = 'dropped_version') AS dropped_versions, count(*) FILTER (WHERE verdict = 'dropped_tombstone') AS dropped_tombstones FROM ({COMPACTED}) c"))
def kv_compact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.compaction_counts(_compacted(spark, sf_dir))


@query(oracle("""
    WITH lv AS (SELECT level, count(*) AS n, sum(bytes) AS b FROM {tables} GROUP BY level),
    f AS (SELECT level, CASE WHEN level = 0 THEN n / 4.0 ELSE b / (65536.0 * pow(10, level - 1)) END AS fullness FROM lv WHERE level < 6),
    p AS (SELECT level, fullness FROM f WHERE fullness >= 1 ORDER BY fullness DESC, level LIMIT 1),
    t AS (SELECT t.*, p.fullness FROM {tables} t JOIN p ON t.level = p.level QUALIFY t.level = 0 OR row_number() OVER (ORDER BY CASE WHEN first_key > 3 THEN 0 ELSE 1 END, first_key, number) = 1),
    c AS (SELECT level, fullness, string_agg(CAST(number AS STRING), ',' ORDER BY number) AS inputs, min(first_key) AS low, max(last_key) AS high FROM t GROUP BY level, fullness)
    SELECT c.level, CAST(c.fullness AS DOUBLE) AS fullness, c.inputs, c.low, c.high, coalesce((SELECT string_agg(CAST(o.number AS STRING), ',' ORDER BY o.number) FROM {tables} o WHERE o.level = c.level + 1 AND o.first_key <= c.high AND o.last_key >= c.low), '') AS next_inputs FROM c
"""))
def kv_compaction_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointers = spark.range(1, 6).select(F.col("id").cast("int").alias("level"), F.lit(3).cast("long").alias("pointer"))
    found = kv.compaction_pick(fixture(spark, sf_dir, "tables"), level1_bytes=65536, pointers=pointers)
    told = [F.array_join(F.transform(c, lambda n: n.cast("string")), ",").alias(c) for c in ("inputs", "next_inputs")]
    return found.select("level", "fullness", "low", "high", *told)


@query(oracle("SELECT number, level, row_number() OVER (ORDER BY level, CASE WHEN level = 0 THEN -number ELSE first_key END, number) AS rank FROM {tables} WHERE 500 BETWEEN first_key AND last_key"))
def kv_table_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.prune_tables(fixture(spark, sf_dir, "tables"), 500)


@query(oracle("SELECT level, count(*) AS tables, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes, max(max_seq) AS max_seq FROM {tables} GROUP BY level"))
def kv_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.levels(fixture(spark, sf_dir, "tables"))


@query(oracle("SELECT number FROM {tables} WHERE number % 3 = 1"))
def kv_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixture(spark, sf_dir, "tables")
    return kv.orphans(tables, tables.filter("number % 3 <> 1"))


@query(oracle("""
    WITH m AS (SELECT CAST(level AS BIGINT) AS manifest, number FROM {tables}), f AS (SELECT number FROM {tables} WHERE number % 7 <> 6 OR number % 2 = 1)
    SELECT max(manifest) AS manifest FROM m WHERE manifest NOT IN (SELECT manifest FROM m WHERE number NOT IN (SELECT number FROM f))
"""))
def kv_manifest_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = fixture(spark, sf_dir, "tables")
    return kv.newest_intact_manifest(tables.select(F.col("level").cast("long").alias("manifest"), "number"), tables.filter("number % 7 <> 6 or number % 2 = 1"))


@query(oracle("""
    WITH l AS (SELECT * FROM {wal} QUALIFY row_number() OVER (PARTITION BY seq ORDER BY segment DESC) = 1),
    s AS (SELECT min(seq) AS stop FROM (SELECT seq, bad, lag(seq) OVER (ORDER BY seq) AS p FROM l) x WHERE bad OR seq - p > 1)
    SELECT segment, seq, value FROM l, s WHERE stop IS NULL OR seq < stop
"""))
def kv_wal_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.wal_prefix(fixture(spark, sf_dir, "wal"))


@query(oracle("SELECT p + 1 AS missing_from, seq - 1 AS missing_to FROM (SELECT seq, lag(seq) OVER (ORDER BY seq) AS p FROM {gapped_wal}) x WHERE seq - p > 1"))
def kv_wal_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.wal_gaps(fixture(spark, sf_dir, "gapped_wal"))


@query(oracle("SELECT segment, max(seq) AS last_seq FROM {wal} GROUP BY segment HAVING max(seq) <= (SELECT CAST(floor(max(seq) * 0.6) AS BIGINT) FROM {wal})"))
def kv_wal_retire(spark: SparkSession, sf_dir: str) -> DataFrame:
    wal = fixture(spark, sf_dir, "wal")
    return kv.segment_retire(wal, _at(wal, 0.6))


@query(oracle(_live("SELECT * FROM {log}")))
def kv_recovery_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    return kv.scan_at(kv.recover(log.filter("op <> 'noop'"), log, _at(log, 0.6)))


@query(oracle(f"SELECT key, seq, value FROM ({NEWEST.format(V7)}) n WHERE op <> 'delete'"))
def kv_checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    path = store.scratch(spark, "checkpoint")
    store.write_checkpoint(log, path, _at(log, 0.7))
    return kv.scan_at(store.open_store(spark, path))


@query(oracle(f"SELECT key, seq, value FROM ({NEWEST.format(V7)}) l WHERE op <> 'delete' AND {IN_SPAN}"))
def kv_checkpoint_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    path = store.scratch(spark, "span")
    store.write_checkpoint(log, path, _at(log, 0.7), fixture(spark, sf_dir, "spans"))
    return kv.scan_at(store.open_store(spark, path))


@query(oracle(f"SELECT side, key, value FROM (SELECT 'left' AS side, * FROM (({_live('SELECT * FROM {log}')}) EXCEPT ({_live('SELECT * FROM {log}', V7)})) a UNION ALL SELECT 'right', * FROM (({_live('SELECT * FROM {log}', V7)}) EXCEPT ({_live('SELECT * FROM {log}')})) b) d"))
def kv_state_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "log")
    return kv.state_difference(kv.scan_at(log), kv.scan_at(log, _at(log, 0.7)))
