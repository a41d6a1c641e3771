"""Queries of the trace measures and of linearizability over traces derived from the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lin, measure
from ..sources.tables import fixture, with_fixtures
from .registry import query


def oracle(sql: str) -> str:
    return with_fixtures(sql)


_STAMPS = """stamps AS (SELECT range_id, server, idx, stamp, stamp_seq FROM (SELECT c.range_id, c.server, unnest(generate_series(c.before + 1, c.idx)) AS idx, c.t AS stamp, c.seq AS stamp_seq
    FROM (SELECT *, coalesce(max(idx) OVER (PARTITION BY range_id, server ORDER BY seq, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {commits}) c WHERE c.idx > c.before) s)"""
_LAGS = "lags AS (SELECT a.range_id, a.server, a.idx, a.t - s.stamp AS lag FROM {applies} a JOIN stamps s USING (range_id, server, idx) WHERE a.t >= s.stamp)"


def _lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.apply_lag(fixture(spark, sf_dir, "applies"), fixture(spark, sf_dir, "commits"))


@query(oracle(f"WITH {_STAMPS}, {_LAGS} SELECT * FROM lags"))
def m_apply_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(spark, sf_dir)


@query(oracle(f"WITH {_STAMPS}, {_LAGS} SELECT range_id, CAST(quantile_disc(lag, 0.5) AS BIGINT) AS median_lag, count(*) AS n, quantile_disc(lag, 0.5) > 1250000 AS slow FROM lags GROUP BY ROLLUP (range_id)"))
def m_apply_lag_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.lag_medians(_lags(spark, sf_dir), 1_250_000)


_HOLDS = f"""WITH {_STAMPS}, o AS (SELECT *, lag(t, 1) OVER w AS t1, lag(t, 2) OVER w AS t0, lag(range_id, 1) OVER w AS prior FROM {{applies}} WINDOW w AS (PARTITION BY server ORDER BY seq, range_id)),
    h AS (SELECT o.server, o.range_id, o.idx, greatest(s.stamp, o.t0) AS held_from, o.t1 AS held_until FROM o JOIN stamps s USING (range_id, server, idx) WHERE o.prior <> o.range_id AND o.t0 IS NOT NULL AND s.stamp <= o.t1),
    x AS (SELECT server, range_id, idx, held_until - held_from AS hold, EXISTS (SELECT 1 FROM {{downs}} d WHERE d.server = h.server AND d.down_t BETWEEN h.held_from AND h.held_until) AS dropped FROM h)"""


@query(oracle(_HOLDS + " SELECT server, range_id, idx, hold, dropped FROM x"))
def m_cross_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.cross_hold(fixture(spark, sf_dir, "applies"), fixture(spark, sf_dir, "commits"), fixture(spark, sf_dir, "downs"))


@query(oracle(_HOLDS + " SELECT CAST(quantile_disc(hold, 0.5) FILTER (WHERE NOT dropped) AS BIGINT) AS median_hold, max(hold) FILTER (WHERE NOT dropped) AS max_hold, count(*) FILTER (WHERE dropped) AS dropped FROM x"))
def m_cross_hold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.hold_summary(m_cross_hold(spark, sf_dir))


_COVER = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{e}') AS {n}" for n, e in (("clicks", "click"), ("errors", "error"), ("purchases", "purchase"), ("signups", "signup"), ("views", "view"))) + ", max(v) AS max_index, bool_or(v > 99) AS any_high, count(DISTINCT user_id) AS clients FROM {trace}"


@query(oracle(f"SELECT {_COVER}"))
def m_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.coverage(fixture(spark, sf_dir, "trace"))


@query(oracle(f"SELECT range_id, {_COVER} GROUP BY range_id"))
def m_coverage_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.coverage(fixture(spark, sf_dir, "trace"), ["range_id"])


@query(oracle("SELECT range_id, count(*) AS records, (max(t) - min(t)) / 1e9 AS seconds, count(*) / greatest((max(t) - min(t)) / 1e9, 2.220446049250313e-16) AS per_second FROM {trace} GROUP BY range_id"))
def m_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.rates(fixture(spark, sf_dir, "trace"))


@query(oracle("SELECT (max(t) - min(t)) / 1e9 AS seconds, count(*) / count(DISTINCT range_id) / ((max(t) - min(t)) / 1e9) AS per_range, (SELECT max(p) FROM (SELECT count(*) / ((max(t) - min(t)) / 1e9) AS p FROM {trace} GROUP BY range_id) r) AS busiest FROM {trace}"))
def m_overall_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.overall_rate(fixture(spark, sf_dir, "trace"))


def _gap_sql(by: str) -> str:
    part, group = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""WITH g AS (SELECT {group}t, seq, lead(t) OVER ({part}ORDER BY t, seq) AS next_t FROM {{completions}}),
        c AS (SELECT g.*, coalesce((SELECT sum(greatest(least(g.next_t, o.until_t) - greatest(g.t, o.from_t), 0)) FROM {{outages}} o WHERE o.from_t < g.next_t AND o.until_t > g.t), 0) AS covered FROM g WHERE next_t IS NOT NULL)
        SELECT {group}CAST(max(next_t - t - covered) AS BIGINT) AS gap FROM c {f'GROUP BY {by}' if by else ''}"""


@query(oracle(_gap_sql("")))
def m_availability_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.availability_gap(fixture(spark, sf_dir, "completions"), fixture(spark, sf_dir, "outages"))


@query(oracle(_gap_sql("range_id")))
def m_availability_gap_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.availability_gap(fixture(spark, sf_dir, "completions"), fixture(spark, sf_dir, "outages"), ["range_id"])


_FINAL = "(SELECT range_id, start, stop, t AS since FROM {meta_updates} QUALIFY row_number() OVER (PARTITION BY range_id ORDER BY generation DESC, idx) = 1)"


@query(oracle(f"""
    WITH wanted AS (SELECT * FROM {_FINAL} f), b AS (SELECT DISTINCT low FROM (SELECT start AS low FROM {{meta_updates}} UNION ALL SELECT stop FROM {{meta_updates}}) x), e AS (SELECT low FROM (SELECT low, lead(low) OVER (ORDER BY low) AS high FROM b) y WHERE high IS NOT NULL),
    n AS (SELECT e.low, u.idx, u.range_id, u.generation, u.t, max(u.generation) OVER (PARTITION BY e.low ORDER BY u.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {{meta_updates}} u JOIN e ON e.low >= u.start AND e.low < u.stop),
    won AS (SELECT *, lag(range_id) OVER (PARTITION BY low ORDER BY idx) AS owner_before FROM n WHERE best IS NULL OR generation > best),
    last AS (SELECT low, arg_max(range_id, idx) AS owner, arg_max(t, idx) AS named_t FROM won WHERE owner_before IS NULL OR owner_before <> range_id GROUP BY low)
    SELECT w.range_id, CASE WHEN bool_and(coalesce(l.owner = w.range_id, false)) THEN greatest(max(l.named_t) - greatest(w.since, 200000000), 0) END AS lag FROM wanted w JOIN e ON e.low >= w.start AND e.low < w.stop LEFT JOIN last l ON l.low = e.low GROUP BY w.range_id, w.since
"""))
def m_meta_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = fixture(spark, sf_dir, "meta_updates")
    wanted = updates.groupBy("range_id").agg(F.max_by(F.struct("start", "stop", "t"), F.struct("generation", -F.col("idx"))).alias("w")).select("range_id", "w.start", "w.stop", F.col("w.t").alias("since"))
    return measure.meta_lag(updates, wanted, 200_000_000)


@query(oracle("""
    WITH b AS (SELECT DISTINCT low FROM (SELECT start AS low FROM {meta_updates} UNION ALL SELECT stop FROM {meta_updates}) x), e AS (SELECT low FROM (SELECT low, lead(low) OVER (ORDER BY low) AS high FROM b) y WHERE high IS NOT NULL),
    n AS (SELECT e.low, u.idx, u.generation, max(u.generation) OVER (PARTITION BY e.low ORDER BY u.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {meta_updates} u JOIN e ON e.low >= u.start AND e.low < u.stop)
    SELECT count(DISTINCT idx) AS resends FROM n WHERE generation > 1 AND best >= generation
"""))
def m_meta_resends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.meta_resends(fixture(spark, sf_dir, "meta_updates"))


@query(oracle("SELECT range_id, start, stop, generation FROM {descriptor_values} QUALIFY row_number() OVER (PARTITION BY range_id ORDER BY idx DESC, seq) = 1"))
def m_latest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.latest_spans(fixture(spark, sf_dir, "descriptor_values"))


@query(oracle("""
    WITH g AS (SELECT * FROM {grants} QUALIFY row_number() OVER (PARTITION BY idx ORDER BY seq) = 1), s AS (SELECT seq + 2000 AS seq, 1 + seq AS right_id FROM {trace} WHERE event_type = 'purchase'),
    r AS (SELECT CAST(seq % 5 AS BIGINT) AS node, seq FROM {trace} WHERE event_type = 'signup' AND seq % 7 = 0)
    SELECT s.seq, s.right_id, g.node FROM s JOIN g ON s.right_id BETWEEN g.first_id AND g.last_id WHERE EXISTS (SELECT 1 FROM r WHERE r.node = g.node AND r.seq > g.seq AND r.seq < s.seq) ORDER BY s.seq, g.node LIMIT 1
"""))
def m_splits_from_earlier_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = fixture(spark, sf_dir, "grants").groupBy("idx").agg(F.min_by(F.struct("node", "first_id", "last_id", "seq"), "seq").alias("x")).select("x.*")
    events = fixture(spark, sf_dir, "trace")
    splits = events.filter("event_type = 'purchase'").selectExpr("seq + 2000 AS seq", "1 + seq AS right_id")
    restarts = events.filter("event_type = 'signup' and seq % 7 = 0").selectExpr("CAST(seq % 5 AS BIGINT) AS node", "seq")
    return measure.splits_from_earlier_run(splits, grants, restarts)


@query(oracle("SELECT count(*) FILTER (WHERE user_id % 3 = 2) AS served FROM {trace} WHERE event_type = 'view'"))
def m_stale_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = fixture(spark, sf_dir, "trace").filter("event_type = 'view'").selectExpr("((user_id % 3) << 32) + user_id AS client")
    return measure.stale_reads_served(returns, 2)


@query(oracle("SELECT node, event_type, count(*) AS n, min(seq) AS first_seq FROM {trace} GROUP BY ALL"))
def m_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.losses(fixture(spark, sf_dir, "trace"))


@query(oracle("SELECT client, invoked, count(*) AS sent, count(DISTINCT generation) AS generations FROM {sends} GROUP BY ALL"))
def m_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.retries(fixture(spark, sf_dir, "sends"))


@query(oracle("SELECT min(seed) AS first_seed, string_agg(CAST(seed AS STRING), ', ' ORDER BY seed) FILTER (WHERE seed > (SELECT min(seed) FROM {verdicts} WHERE failed AND variant = 'plain')) AS others FROM (SELECT DISTINCT seed FROM {verdicts} WHERE failed AND variant = 'plain') s"))
def m_sweep_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.sweep_verdict(fixture(spark, sf_dir, "verdicts").filter("variant = 'plain'"))


@query(oracle("SELECT variant, check_name, count(DISTINCT seed) AS seeds, count(DISTINCT seed) FILTER (WHERE failed) AS caught FROM {verdicts} GROUP BY ALL"))
def m_catch_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.catch_rates(fixture(spark, sf_dir, "verdicts"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations on registers: calls from the trace, returns of puts and deletes, some late and some lost."""
    rows = fixture(spark, sf_dir, "history")
    invokes = rows.select("process", "pseq", "key", "op", (F.col("seq") % 7).alias("value"), F.when(F.col("seq") % 2 == 0, F.col("seq") % 7).alias("expect"), (F.col("seq") * 10).alias("t"), "seq")
    proposals = rows.filter("seq % 13 <> 0").select("process", "pseq", F.lit(1).alias("range_id"), F.col("seq").alias("idx"), F.lit(1).alias("term"))
    applies = rows.filter("seq % 17 <> 0").select(F.lit(1).alias("range_id"), F.col("seq").alias("idx"), F.lit(1).alias("term"), F.when(F.col("seq") % 19 == 0, "refused").otherwise("applied").alias("effect"), (F.col("seq") * 10 + 5).alias("t"), "seq")
    returns = rows.filter("seq % 5 <> 0 and op in ('put', 'delete')").select("process", "pseq", F.lit(None).cast("long").alias("result"), F.lit(None).cast("boolean").alias("swapped"), (F.col("seq") * 10 + 9).alias("t"), "seq")
    return lin.build_history(invokes, returns, proposals, applies)


@query(oracle("""
    WITH r AS (SELECT *, (seq % 5 <> 0 AND op IN ('put', 'delete')) AS returned, seq % 13 <> 0 AS proposed, seq % 17 <> 0 AS applied, seq % 19 = 0 AS refused FROM {history})
    SELECT process, pseq, key, op, seq * 10 AS call, CASE WHEN returned THEN seq * 10 + 9 WHEN proposed AND applied AND NOT refused THEN seq * 10 + 5 END AS ret, returned AS known,
        CASE WHEN returned THEN 'returned' WHEN NOT proposed THEN 'never_proposed' WHEN applied AND NOT refused THEN 'closed_by_apply' WHEN applied THEN 'applied_as_nothing' ELSE 'pending' END AS fate FROM r
"""))
def lin_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select("process", "pseq", "key", "op", "call", "ret", "known", "fate")


WRONG = 100


def _registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an operation on the register of its user, applied in order of seq, with the result it had.

    Some are never proposed, never applied or refused, and some returns are lost. Answers come up to 4000
    steps late, so operations overlap. A few are wrong on purpose: a get returns WRONG, a cas the opposite.
    """
    rows = fixture(spark, sf_dir, "trace").selectExpr(
        "CAST(user_id % 25 AS BIGINT) AS process", "seq AS pseq", "lpad(CAST(user_id AS STRING), 12, '0') AS key", "seq % 7 AS value", "IF(seq % 2 = 0, v % 7, NULL) AS expect", "seq",
        "CASE event_type WHEN 'click' THEN 'put' WHEN 'purchase' THEN 'cas' WHEN 'error' THEN 'delete' ELSE 'get' END AS op", "seq % 13 <> 0 AS proposed", "seq % 17 <> 0 AS applied", "seq % 19 = 0 AS refused",
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held, results, swaps = None, [], []
        pdf = pdf.sort_values("seq")
        for r in pdf.itertuples():
            expect = None if pd.isna(r.expect) else int(r.expect)
            went = r.proposed and r.applied and not r.refused
            swaps.append(held == expect if went and r.op == "cas" else None)
            results.append(held if went and r.op == "get" else None)
            if went:
                held = lin.run_register((r.op, int(r.value), expect, False, None, None), held)[1]
        return pdf.assign(result=pd.array(results, "Int64"), swapped=pd.array(swaps, "boolean"), expect=pdf["expect"].astype("Int64"))

    schema = "process long, pseq long, key string, value long, expect long, seq long, op string, proposed boolean, applied boolean, refused boolean, result long, swapped boolean"
    ran = rows.groupBy("key").applyInPandas(run, schema)
    place = [F.lit(1).alias("range_id"), F.col("seq").alias("idx"), F.lit(1).alias("term")]
    invokes = ran.select("process", "pseq", "key", "op", "value", "expect", (F.col("seq") * 10).alias("t"), "seq")
    proposals = ran.filter("proposed").select("process", "pseq", *place)
    applies = ran.filter("applied").select(*place, F.when(F.col("refused"), "refused").otherwise("applied").alias("effect"), (F.col("seq") * 10 + 5).alias("t"), "seq")
    result = F.when((F.col("op") == "get") & (F.col("seq") % 211 == 7), F.lit(WRONG).cast("long")).otherwise(F.col("result"))
    swapped = F.when(F.col("seq") % 307 == 5, ~F.col("swapped")).otherwise(F.col("swapped"))
    late = F.col("seq") * 10 + 9 + F.col("seq") % 11 * 400
    returns = ran.filter("seq % 5 <> 0 and proposed and applied and not refused").select("process", "pseq", result.alias("result"), swapped.alias("swapped"), late.alias("t"), "seq")
    return lin.build_history(invokes, returns, proposals, applies)


@query()
def lin_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.verdicts(_registers(spark, sf_dir))


@query()
def lin_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.timeline(_registers(spark, sf_dir))
