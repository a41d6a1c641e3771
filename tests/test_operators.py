"""Small cases of the operators: each rule that a plausible wrong version would break."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import intervals, scalar
from tracelake.operators import checks, kv, lin, log, measure, ranges, replica, sql, trace
from tracelake.sources import echo, jsonl, store

WRITES = "key binary, seq long, ord int, op string, value string"


def rows(df):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()]


@pytest.fixture(scope="module")
def writes(spark):
    return spark.createDataFrame([(b"a", 1, 0, "put", "1"), (b"b", 1, 1, "put", "2"), (b"a", 2, 0, "delete", None), (b"a\0", 3, 0, "put", ""), (b"a", 4, 0, "put", "3"), (b"a", 4, 1, "put", "4"), (b"\xff", 5, 0, "put", None), (b"b", 6, 0, "delete", None)], WRITES)


def test_newest_write_and_tombstones(writes):
    assert rows(kv.scan_at(writes)) == [(b"a", 4, "4"), (b"a\0", 3, ""), (b"\xff", 5, None)]
    assert rows(kv.scan_at(writes, 2)) == [(b"b", 1, "2")]
    assert rows(kv.get_at(writes, F.lit(b"a"), 3)) == []
    assert rows(kv.seek(writes, 2, 6)) == [(b"a", 4, "4"), (b"a\0", 3, "")]
    assert rows(kv.seek(writes, 0)) == []


def test_limit_counts_live_keys_only(spark):
    few = spark.createDataFrame([(b"a", 1, 0, "delete", None), (b"b", 1, 1, "put", "x"), (b"c", 1, 2, "put", "y")], WRITES)
    assert [r[0] for r in rows(kv.seek(few, 1))] == [b"b"]


def test_range_delete_takes_history_and_leaves_later_writes(spark, writes):
    spans = spark.createDataFrame([(b"a", b"b")], "start binary, stop binary")
    left = kv.delete_ranges(writes, spans, 4)
    assert rows(kv.scan_at(left, 3)) == [(b"b", 1, "2")]
    assert rows(kv.scan_at(left)) == [(b"a", 4, "4"), (b"\xff", 5, None)]


def test_install_renumbers_and_repair_wins(spark, writes):
    spans = spark.createDataFrame([(b"a", b"c")], "start binary, stop binary")
    source = spark.createDataFrame([(b"a", 90, 0, "put", "new"), (b"b", 91, 0, "delete", None), (b"z", 92, 0, "put", "outside")], WRITES)
    repair = spark.createDataFrame([(b"a", 0, "put", "fixed")], "key binary, ord int, op string, value string")
    after = kv.install_spans(writes, spans, source, 7, repair)
    assert rows(kv.scan_at(after, 7)) == [(b"a", 7, "new"), (b"\xff", 5, None)]
    assert rows(kv.scan_at(after)) == [(b"a", 8, "fixed"), (b"\xff", 5, None)]
    assert rows(kv.scan_at(after, 5)) == [(b"\xff", 5, None)]


def test_compaction_keeps_what_a_snapshot_reads(writes):
    for oldest in range(7):
        kept = kv.compact(writes, oldest).filter("verdict = 'kept'").drop("verdict")
        for version in range(oldest, 7):
            assert rows(kv.scan_at(kept, version)) == rows(kv.scan_at(writes, version)), (oldest, version)


def test_compaction_keeps_a_tombstone_over_a_deeper_table(spark):
    tomb = spark.createDataFrame([(b"k", 3, 0, "delete", None)], WRITES)
    deeper = spark.createDataFrame([(b"a", b"m")], "first_key binary, last_key binary")
    assert rows(kv.compact(tomb, 5).select("verdict")) == [("dropped_tombstone",)]
    assert rows(kv.compact(tomb, 5, deeper).select("verdict")) == [("kept",)]


def test_wal_prefix_stops_at_damage_and_gaps(spark):
    wal = spark.createDataFrame([(0, 1, False, "a"), (0, 2, True, "b"), (1, 2, False, "c"), (1, 3, False, "d"), (1, 5, False, "e")], "segment long, seq long, bad boolean, value string")
    assert sorted(rows(kv.wal_prefix(wal))) == [(0, 1, "a"), (1, 2, "c"), (1, 3, "d")]
    assert rows(kv.wal_gaps(wal)) == [(4, 4)]


def test_checkpoint_refuses_overwriting_and_other_formats(spark, writes, tmp_path):
    path = str(tmp_path / "cp")
    store.write_checkpoint(writes, path, 5)
    assert rows(kv.scan_at(store.open_store(spark, path))) == rows(kv.scan_at(writes, 5))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.write_checkpoint(writes, path, 5)
    spark.range(1).selectExpr("1 AS format_version").write.mode("overwrite").json(f"{path}/format")
    with pytest.raises(store.WrongFormat):
        store.open_store(spark, path)
    assert rows(store.verify_table(spark.read.parquet(f"{path}/data"), 4)) == [(4, 0, True)]


def test_cas_absent_equals_absent(spark):
    made = spark.createDataFrame([(1, "k", 1, "cas", 5, None), (1, "k", 2, "cas", 6, 4), (1, "k", 3, "get", None, None), (1, "k", 4, "delete", None, None), (1, "k", 5, "cas", 7, None), (1, "k", 6, "get", None, None)], "range_id long, key string, idx long, kind string, value long, expect long")
    found = log.cas_outcomes(made).orderBy("idx").select("swapped", "held").collect()
    assert [tuple(r) for r in found] == [(True, None), (False, None), (None, 5), (None, None), (True, None), (None, 7)]


def test_merge_by_generation_equals_one_by_one(spark):
    random.seed(5)
    updates = [(k, random.randrange(30), random.randrange(30), random.randrange(5), k) for k in range(40)]
    owner: dict[int, tuple[int, int]] = {}
    for rid, start, stop, generation, _ in updates:
        for key in range(start, stop):
            if key not in owner or generation > owner[key][1]:
                owner[key] = rid, generation
    made = ranges.merge_generation(spark.createDataFrame([(*u, "live") for u in updates], "range_id long, start long, stop long, generation long, arrival long, state string"))
    assert {key: (r.range_id, r.generation) for r in made.collect() for key in range(r.low, r.high)} == owner


def test_lookup_at_a_boundary_goes_right(spark):
    owned = spark.createDataFrame([(0, 10, 1, 1), (10, 20, 2, 1), (30, 40, 3, 1)], "low long, high long, range_id long, generation long")
    keys = spark.createDataFrame([(9,), (10,), (25,), (30,), (-1,)], "key long")
    assert sorted(rows(ranges.lookup(keys, owned).select("key", "range_id")), key=str) == sorted([(9, 1), (10, 2), (25, None), (30, 3), (-1, None)], key=str)


def test_as_of_before_and_at(spark):
    left = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "k long, idx long")
    right = spark.createDataFrame([(1, 5, "x"), (1, 2, "y")], "k long, idx long, v string")
    assert sorted(rows(intervals.as_of(left, right, ["k"], "idx").select("k", "idx", "found.v")), key=str) == [(1, 5, "x"), (1, 6, "x"), (2, 5, None)]
    assert sorted(rows(intervals.as_of(left, right, ["k"], "idx", inclusive=False).select("k", "idx", "found.v")), key=str) == [(1, 5, "y"), (1, 6, "x"), (2, 5, None)]


@pytest.mark.parametrize("inclusive", [True, False])
def test_as_of_in_buckets_equals_one_window(spark, inclusive):
    random.seed(8)
    left = spark.createDataFrame([(random.randrange(2), random.randrange(-50, 300), k) for k in range(200)], "k long, idx long, n long")
    right = spark.createDataFrame([(random.randrange(2), random.randrange(-20, 200), k) for k in range(15)], "k long, idx long, v long")
    whole = sorted(map(tuple, intervals.as_of(left, right, ["k"], "idx", inclusive).collect()))
    for width in (1, 7, 1000):
        assert sorted(map(tuple, intervals.as_of(left, right, ["k"], "idx", inclusive, width=width).collect())) == whole


def test_next_row_in_buckets(spark):
    random.seed(9)
    made = [(random.randrange(3), random.randrange(100), n) for n in range(80)]
    want = []
    for key in range(3):
        own = sorted((t, n) for k, t, n in made if k == key)
        want += [(key, t, n, own[j + 1][0] if j + 1 < len(own) else None) for j, (t, n) in enumerate(own)]
    for width in (1, 9, 500):
        found = intervals.with_next(spark.createDataFrame(made, "k long, t long, n long"), ["k"], "t", "n", width, "after")
        assert sorted(map(tuple, found.select("k", "t", "n", "after").collect()), key=str) == sorted(want, key=str)


def test_split_lineage_follows_the_new_half(spark):
    have = spark.createDataFrame([(1, 0, 100, 1, "live")], "range_id long, start long, stop long, generation long, state string")
    asked = spark.createDataFrame([(1, 1, 50, 7, False), (2, 1, 75, 8, False), (3, 1, 50, 9, False), (4, 1, 20, None, False)], "idx long, range_id long, split_at long, right_id long, joint boolean")
    assert sorted(rows(ranges.split_lineage(asked, have).select("range_id", "start", "stop", "generation"))) == [(1, 0, 50, 2), (7, 50, 75, 3), (8, 75, 100, 3)]


def test_log_view_against_a_replay(spark):
    random.seed(11)
    alive, done, appends, cuts = {}, [], [], []
    for seq in range(300):
        server = random.randrange(2)
        if random.random() < 0.15:
            low = random.randrange(12)
            cuts.append((0, server, low, seq))
            for (s, i), (f, h) in list(alive.items()):
                if s == server and i >= low:
                    done.append((s, i, h, f, seq))
                    del alive[s, i]
        else:
            i = random.randrange(12)
            if (server, i) in alive:
                f, h = alive.pop((server, i))
                done.append((server, i, h, f, seq))
            alive[server, i] = seq, seq * 7
            appends.append((0, server, i, 1, seq * 7, seq))
    done += [(s, i, h, f, None) for (s, i), (f, h) in alive.items()]
    view = checks.log_view(spark.createDataFrame(appends, "range_id long, server long, idx long, term long, hash long, seq long"), spark.createDataFrame(cuts, "range_id long, server long, from_idx long, seq long"))
    assert sorted(rows(view.select("server", "idx", "hash", "from_seq", "to_seq")), key=str) == sorted(done, key=str)


def test_state_difference_tells_versions_of_one_value(spark):
    a = spark.createDataFrame([("a", 9, "1"), ("b", 2, "2"), ("c", 3, "3")], "key string, seq long, value string")
    b = spark.createDataFrame([("a", 1, "1"), ("b", 2, "2")], "key string, seq long, value string")
    assert sorted(rows(kv.state_difference(a, b).select("side", "key", "value"))) == [("left", "a", "1"), ("left", "c", "3"), ("right", "a", "1")]


def joins_of(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]


@pytest.mark.parametrize("kinds", ["t", "i", "c", "tic"])
def test_log_view_equals_brute_force_without_pairs(spark, kinds):
    """Truncates, installs and creations of two replicas, ties of seq and negative indices among them; and no entry is joined with cuts."""
    random.seed(12)
    appends = [(0, random.randrange(2), random.randrange(-5, 90), 1, k, k // 2 * 3) for k in range(400)]
    cuts = {kind: [(0, random.randrange(2), random.randrange(-9, 99), random.randrange(0, 620)) for _ in range(40 if kind in kinds else 0)] for kind in "tic"}
    reaches = {"t": lambda bound, idx: bound <= idx, "i": lambda bound, idx: bound >= idx, "c": lambda bound, idx: True}
    want = []
    for r, s, i, term, h, seq in appends:
        ends = [a[5] for a in appends if a[1:3] == (s, i) and a[5] > seq]
        ends += [at for kind in "tic" for _, server, bound, at in cuts[kind] if server == s and at > seq and reaches[kind](bound, i)]
        want.append((s, i, h, seq, min(ends, default=None)))
    entry = "range_id long, server long, idx long, term long, hash long, seq long"
    appends = [a for k, a in enumerate(appends) if k % 2 == 0 or a[1:3] != appends[k - 1][1:3]]  # no index twice at one seq
    want = [w for w in want if any(a[4] == w[2] for a in appends)]
    made = {kind: spark.createDataFrame(cuts[kind], f"range_id long, server long, {'last_idx' if kind == 'i' else 'from_idx'} long, seq long") for kind in "tic"}
    view = checks.log_view(spark.createDataFrame(appends, entry), made["t"], made["i"].withColumn("taken", F.lit(False)), made["c"])
    assert sorted(rows(view.select("server", "idx", "hash", "from_seq", "to_seq")), key=str) == sorted(want, key=str)
    assert not joins_of(view)


def test_numbering_in_buckets_is_row_number(spark):
    random.seed(5)
    places = random.sample(range(-300, 900), 400)
    made = spark.createDataFrame([(k % 3 or None, p) for k, p in enumerate(places)], "k long, seq long")
    want = [(k, p, sum(1 for m, q in enumerate(places) if (m % 3 or None) == k and q <= p)) for k, p in ((n % 3 or None, p) for n, p in enumerate(places))]
    assert sorted(rows(intervals.numbered(made, ["k"], "seq", "n", width=64)), key=str) == sorted(want, key=str)


def test_no_window_of_the_log_view_takes_a_replica_whole(spark):
    """Windows over all of a replica hold its cuts, or a row a bucket; entries, which have a hash, go by index or by buckets of lines."""
    appends = spark.range(1000).selectExpr("id % 2 as range_id", "1L as server", "id as idx", "1L as term", "id as hash", "id * 1000 as seq")
    cuts = spark.range(50).selectExpr("id % 2 as range_id", "1L as server", "id * 20 as from_idx", "id * 20000 + 1 as seq")
    view = checks.log_view(appends, cuts)
    assert view.count() == 1000
    windows = [line for line in view._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    by = [line.split("windowspecdefinition(")[1].split(" ASC")[0].split(" DESC")[0] for line in windows]
    assert any("bucket#" in b for b in by) and any("idx#" in b for b in by)
    assert not [line for line, b in zip(windows, by, strict=True) if "row#" in line and "bucket#" not in b]


def test_what_lies_below_the_floor_need_not_be_viewed(spark):
    entry = "range_id long, server long, idx long, term long, hash long, seq long"
    appends = spark.createDataFrame([(0, s, i, 1, 10 * i + s, 10 * i + s) for s in (1, 2) for i in range(1, 9)] + [(0, 1, 7, 2, 99, 200)], entry)
    cuts = spark.createDataFrame([(0, 2, 6, 150), (0, 1, 8, 100)], "range_id long, server long, from_idx long, seq long")
    floors = checks.floors(spark.createDataFrame([(0, 1, 5, 1, 60, True)], "range_id long, server long, last_idx long, term long, seq long, taken boolean"))
    above = replica.above_floor(appends, floors)
    assert above.count() == 12
    want = rows(replica.retained(checks.log_view(appends, cuts), floors))
    assert sorted(rows(replica.retained(checks.log_view(above, cuts), floors))) == sorted(want) and len(want) == 7


def test_log_matching_needs_both_at_once(spark):
    cols = "range_id long, server long, idx long, term long, hash long, from_seq long, to_seq long"
    apart = spark.createDataFrame([(0, 1, 3, 1, 10, 0, 5), (0, 2, 3, 1, 11, 5, None)], cols)
    together = spark.createDataFrame([(0, 1, 3, 1, 10, 0, 6), (0, 2, 3, 1, 11, 5, None)], cols)
    assert rows(checks.log_matching(apart)) == []
    assert rows(checks.log_matching(together)) == [(0, 3, 1, 1, 2, "payload", 5)]


def test_log_matching_looks_at_the_entry_before(spark):
    cols = "range_id long, server long, idx long, term long, hash long, from_seq long, to_seq long"
    above = [(0, 1, 2, 2, 10, 3, None), (0, 2, 2, 2, 10, 4, None)]
    other = [(0, 1, 1, 1, 5, 1, None), (0, 2, 1, 2, 6, 2, None)]
    assert rows(checks.log_matching(spark.createDataFrame(above + other, cols))) == [(0, 2, 2, 1, 2, "before", 4)]
    one = spark.createDataFrame(above + other[:1], cols)
    assert rows(checks.log_matching(one)) == [(0, 2, 2, 1, 2, "before", 4)]  # an entry against none
    covered = spark.createDataFrame([(0, 2, 1, 1, 2, None)], "range_id long, server long, floor long, term long, from_seq long, to_seq long")
    assert rows(checks.log_matching(one, covered)) == []
    assert rows(checks.log_matching(spark.createDataFrame(above, cols))) == []
    mended = [(0, 1, 1, 1, 5, 1, 4), (0, 1, 1, 2, 6, 4, None), (0, 2, 1, 2, 6, 2, None)]  # by the time the second came, they agreed
    assert rows(checks.log_matching(spark.createDataFrame(above + mended, cols))) == []


def test_leader_completeness_equals_brute_force(spark):
    random.seed(21)
    commits = [(0, i, random.randrange(1, 6), random.randrange(1, 6), random.randrange(1, 80)) for i in range(1, 25)]
    leaders = [(0, s, random.randrange(1, 9), random.randrange(1, 100)) for s in (1, 2, 3) for _ in range(8)]
    entries = []
    for s in (1, 2, 3):
        for _, i, term, _, _ in commits:
            at = random.randrange(0, 40)
            for _ in range(random.randrange(0, 3)):
                end = at + random.randrange(5, 60)
                entries.append((0, s, i, random.choice([term, term, 9]), 1, at, random.choice([end, end, None])))
                if entries[-1][-1] is None:
                    break
                at = end + random.randrange(0, 10)
    want = set()
    for _, s, led, elected in leaders:
        gone = [i for _, i, term, in_term, at in commits if in_term < led and at < elected and not any(e[1] == s and e[2] == i and e[3] == term and e[5] <= elected and (e[6] is None or e[6] > elected) for e in entries)]
        if gone:
            want.add((0, led, s, min(gone), elected))
    least = {}
    for r, led, s, i, seq in want:
        a, b = least.get((r, led, s), (i, seq))
        least[r, led, s] = min(a, i), min(b, seq)
    found = checks.leader_completeness(
        spark.createDataFrame(commits, "range_id long, idx long, entry_term long, term long, seq long"), spark.createDataFrame(leaders, "range_id long, server long, term long, seq long"),
        spark.createDataFrame(entries, "range_id long, server long, idx long, term long, hash long, from_seq long, to_seq long"),
    )
    assert {(r.range_id, r.led, r.server): (r.idx, r.seq) for r in found.collect()} == least and least


def test_leader_completeness_meets_lacks_by_blocks_of_time(spark):
    """Each of 3 servers lacks entries from the commit on, and was elected as often: all pairs would be lacks times elections."""
    n = 300
    commits = [(0, i, 1, 1 + i % 3, 2 * i) for i in range(1, n)]
    leaders = [(0, s, 1 + (k * 7 + s) % 5, 2 * k + 1) for s in (1, 2, 3) for k in range(n)]
    entries = [(0, s, i, 1, 1, 2 * i - 1, random.Random(i * s).choice([None, 2 * i + 50])) for s in (1, 2, 3) for i in range(1, n)]
    least = {}
    for _, s, led, elected in leaders:
        for (_, i, _, in_term, at), e in zip(commits, [e for e in entries if e[1] == s], strict=True):
            if in_term < led and at < elected and e[6] is not None and e[6] <= elected:
                a, b = least.get((led, s), (i, elected))
                least[led, s] = min(a, i), min(b, elected)
    found = checks.leader_completeness(
        spark.createDataFrame(commits, "range_id long, idx long, entry_term long, term long, seq long"), spark.createDataFrame(leaders, "range_id long, server long, term long, seq long"),
        spark.createDataFrame(entries, "range_id long, server long, idx long, term long, hash long, from_seq long, to_seq long"),
    )
    assert {(r.led, r.server): (r.idx, r.seq) for r in found.collect()} == least and least
    assert not [line for line in joins_of(found) if "elected" in line]


def test_blocks_of_a_place_and_a_span_meet_once(spark):
    spans = [(a, b) for a in range(0, 19) for b in range(a, 20)]
    found = spark.createDataFrame(spans, "a long, b long").select("a", "b", intervals.span_blocks(F.col("a"), F.col("b"), 5).alias("blocks")).collect()
    points = {r.x: set(map(tuple, r.blocks)) for r in spark.range(20).toDF("x").select("x", intervals.point_blocks(F.col("x"), 5).alias("blocks")).collect()}
    for r in found:
        assert [sum(tuple(b) in points[x] for b in r.blocks) for x in range(20)] == [int(r.a <= x < r.b) for x in range(20)]


def test_span_joins_equal_brute_force(spark):
    random.seed(3)
    a = [(random.randrange(2), k, x := random.randrange(200), x + random.choice([0, 1, 5, 90])) for k in range(60)]
    b = [(random.randrange(2), k, x := random.randrange(-20, 200), x + random.choice([0, 2, 9, 150])) for k in range(60)]
    left, right = spark.createDataFrame(a, "k long, n long, a long, b long"), spark.createDataFrame(b, "k long, m long, c long, d long")
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and max(p[2], q[2]) < min(p[3], q[3]))
    inside = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and q[2] <= p[2] < q[3])
    for width in (None, 1, 7, 1000):
        assert sorted(rows(intervals.overlapping(left, right, ("a", "b"), ("c", "d"), ["k"], width).select("n", "m"))) == want
        assert sorted(rows(intervals.covering(left, right, "a", "c", "d", ["k"], width).select("n", "m"))) == inside


def test_owner_overlap_equals_brute_force(spark):
    random.seed(4)
    held = [(random.randrange(2), k, x := random.randrange(60), x + random.randrange(0, 15), t := random.randrange(50), random.choice([None, t + random.randrange(1, 30)])) for k in range(50)]
    want = {}
    for p in held:
        over = [max(p[2], q[2]) for q in held if p[0] == q[0] and p[1] != q[1] and max(p[2], q[2]) < min(p[3], q[3]) and q[4] < p[4] and (q[5] is None or q[5] > p[4])]
        if over:
            want[p[0], p[1]] = min(over), p[4]
    found = checks.owner_overlap(spark.createDataFrame(held, "node long, range_id long, start long, stop long, from_seq long, to_seq long"))
    assert {(r.node, r.range_id): (r.low, r.seq) for r in found.collect()} == want and want


def test_frames_keep_the_cap_and_take_ranges_in_turn(spark):
    made = [(1, 0, 7, k, 9) for k in range(3)] + [(1, 0, 8, 9, 4), (1, 1, 8, 10, 30), (2, 5, 1, 11, 10), (1, 40, 3, 12, 5)]
    found = sorted(rows(ranges.outbox_frames(spark.createDataFrame(made, "peer long, flush long, range_id long, seq long, bytes long").repartition(3), 15)))
    assert found == [(1, -1, -1, 8, 10, 30), (1, 0, 0, 7, 0, 9), (1, 0, 1, 8, 9, 4), (1, 1, 0, 7, 1, 9), (1, 2, 0, 7, 2, 9), (1, 40, 0, 3, 12, 5), (2, 5, 0, 1, 11, 10)]
    assert [m[:3] for m in ranges.cut_frames([(0, 7, 0, 9)], 10, head=1)] == [(0, 0, 7)] and [m[0] for m in ranges.cut_frames([(0, 7, 0, 9)], 10, head=1, tag=1)] == [-1]
    random.seed(6)
    many = sorted((f, random.randrange(4), k, random.randrange(1, 12)) for k, f in enumerate(random.randrange(30) for _ in range(300)))
    out = list(ranges.cut_frames(many, 40, head=2, tag=1))
    assert sorted(m[3] for m in out) == sorted(m[2] for m in many)
    for flush in {m[0] for m in out}:
        own = [m for m in out if m[0] == flush]
        assert 2 + sum(1 + m[4] for m in own) <= 40 and [m[1] for m in own] == list(range(len(own)))
    for range_id in range(4):  # a range's messages keep their order
        assert [m[3] for m in out if m[2] == range_id] == [m[2] for m in many if m[1] == range_id]


def test_a_range_left_out_leads_the_next_frame():
    found = list(ranges.cut_frames([(0, 1, 0, 6), (0, 2, 1, 6), (0, 1, 2, 3)], 10))
    assert [(m[0], m[2], m[3]) for m in found] == [(0, 1, 0), (0, 1, 2), (1, 2, 1)]


def test_compaction_takes_all_of_level_zero_and_walks_deeper_ones(spark):
    cols = "level int, number long, first_key long, last_key long, entries long, bytes long, max_seq long"
    zero = [(0, k, 10 * k, 10 * k + 15, 1, 1, 1) for k in range(4)] + [(1, 50, 0, 4, 1, 1, 1), (1, 51, 5, 30, 1, 1, 1), (1, 52, 46, 50, 1, 1, 1)]
    found = kv.compaction_pick(spark.createDataFrame(zero, cols)).first()
    assert (found.level, found.inputs, found.low, found.high, found.next_inputs) == (0, [0, 1, 2, 3], 0, 45, [50, 51])
    one = spark.createDataFrame([(1, 5, 0, 9, 1, 60, 1), (1, 6, 20, 29, 1, 60, 1), (2, 7, 25, 40, 1, 1, 1)], cols)
    picks = [kv.compaction_pick(one, 100, None if p is None else spark.createDataFrame([(1, p)], "level int, pointer long")).first() for p in (None, 0, 20)]
    assert [(p.inputs, p.next_inputs) for p in picks] == [([5], []), ([6], [7]), ([5], [])]
    assert rows(kv.compaction_pick(one, 1000)) == []


def test_a_cas_known_not_to_swap_is_a_read():
    ops = [("cas", 9, 100 + k, True, None, False) for k in range(22)] + [("put", 1, None, True, None, None)]
    assert lin.search(ops, [0] * 23, [100] * 23, budget=200)[0] == "ok"
    assert not lin.reads_only(("cas", 9, 1, False, None, None), 2) and not lin.reads_only(("cas", 9, 2, True, None, False), 2)
    assert lin.reads_only(("get", None, None, False, None, None), 2) and not lin.reads_only(("get", None, None, True, 3, None), 2)


def test_a_stale_update_that_won_nothing_is_no_violation(spark):
    cols = "idx long, range_id long, start long, stop long, generation long, seq long"
    won = spark.createDataFrame([(1, 1, 0, 10, 3, 1), (1, 1, 0, 10, 3, 2), (3, 2, 4, 6, 2, 9), (2, 1, 0, 10, 4, 8)], cols)
    assert sorted(rows(checks.meta_monotone(won))) == [(4, 6, 3, 2, 4, 2, 9)]
    assert rows(checks.meta_monotone(won.filter("idx < 3"))) == []


def test_hot_keys_stream_through_compare_and_set(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = spark.createDataFrame([(1, "k", k, "cas", k + 1, k or None) for k in range(100)], "range_id long, key string, idx long, kind string, value long, expect long").repartition(4)
        assert [r.swapped for r in log.cas_outcomes(made).orderBy("idx").collect()] == [True] * 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_first_violation_and_ranks(spark):
    bad = spark.createDataFrame([(9, "b"), (4, "a")], "seq long, what string")
    assert rows(checks.first_violation(bad).select("seq", "what")) == [(4, "a")]
    ranked = checks.verdicts({"tiling": bad, "ids_unique": bad, "client_refresh": bad.limit(0)})
    assert [r.check_name for r in ranked.orderBy("rank").collect()] == ["ids_unique", "tiling", "client_refresh"]


def test_unknown_effect_agrees_with_any(spark):
    cols = "range_id long, server long, idx long, term long, hash long, effect string, seq long"
    good = spark.createDataFrame([(0, 1, 1, 1, 5, "applied", 1), (0, 2, 1, 1, 5, None, 2)], cols)
    assert rows(checks.state_machine_safety(good)) == []
    bad = spark.createDataFrame([(0, 1, 1, 1, 5, "applied", 1), (0, 2, 1, 1, 5, "refused", 2)], cols)
    assert rows(checks.state_machine_safety(bad)) == [(0, 1, 1, 2, 1)]


def test_reset_forgets_commits(spark):
    commits = spark.createDataFrame([(0, 1, 9, 1)], "range_id long, server long, idx long, seq long")
    cut = spark.createDataFrame([(0, 1, 5, 3)], "range_id long, server long, from_idx long, seq long")
    never = spark.createDataFrame([], "range_id long, server long, seq long")
    forgot = spark.createDataFrame([(0, 1, 2)], "range_id long, server long, seq long")
    assert rows(checks.committed_not_truncated(commits, cut, never)) == [(0, 1, 5, 9, 3)]
    assert rows(checks.committed_not_truncated(commits, cut, forgot)) == []


PUT, GET = "put", "get"


@pytest.mark.parametrize(("ops", "status"), [
    ([(PUT, 1, None, 0, 1), (GET, None, 1, 2, 3)], "ok"),
    ([(PUT, 1, None, 0, 1), (PUT, 2, None, 2, 3), (GET, None, 1, 4, 5)], "violation"),
    ([(PUT, 1, None, 0, 9), (PUT, 2, None, 0, 9), (GET, None, 1, 10, 11)], "ok"),
    ([(PUT, 1, None, 0, None), (GET, None, None, 5, 6), (GET, None, 1, 7, 8)], "ok"),
    ([(PUT, 1, None, 0, None), (GET, None, 1, 5, 6), (GET, None, None, 7, 8)], "violation"),
    ([(GET, None, 4, 0, 1)], "violation"),
])
def test_linearizability(ops, status):
    made = [(kind, value, None, True, result, None) for kind, value, result, _, _ in ops]
    assert lin.search(made, [o[3] for o in ops], [o[4] for o in ops])[0] == status


def test_linearizability_by_construction(spark):
    random.seed(2)
    held, out = None, []
    for k in range(60):
        at, kind = k * 10, random.choice(["put", "get", "delete", "cas"])
        value, expect = random.randrange(3), random.choice([held, 1, None])
        ok, after = lin.run_register((kind, value, expect, False, None, None), held)
        out.append((k % 6, k, "k", kind, value, expect, max(0, at - random.randrange(25)), at + 1 + random.randrange(25), True, held if kind == "get" else None, (held == expect) if kind == "cas" else None))
        held = after
    cols = "process long, pseq long, key string, op string, value long, expect long, call long, ret long, known boolean, result long, swapped boolean"
    history = spark.createDataFrame(out, cols)
    assert lin.verdicts(history).first().status == "ok"
    assert lin.verdicts(history, budget=3).first().status == "exhausted"
    assert lin.timeline(history).count() > 0


def test_lower_median_and_outages(spark):
    lags = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4)], "range_id long, lag long")
    assert {(r.range_id, r.median_lag) for r in measure.lag_medians(lags, 5).collect()} == {(1, 2), (None, 2)}
    done = spark.createDataFrame([(0, 1), (100, 2), (110, 3)], "t long, seq long")
    out = spark.createDataFrame([(10, 60), (70, 200)], "from_t long, until_t long")
    assert rows(measure.availability_gap(done, out)) == [(20,)]
    assert rows(measure.availability_gap(done.limit(1), out)) == []


def test_commit_stamps_once(spark):
    commits = spark.createDataFrame([(0, 1, 2, 1, 10), (0, 1, 1, 2, 20), (0, 1, 4, 3, 30)], "range_id long, server long, idx long, seq long, t long")
    assert sorted(rows(measure.commit_stamps(commits).select("idx", "stamp"))) == [(1, 10), (2, 10), (3, 30), (4, 30)]


def test_known_hashes():
    assert scalar.crc32c_bytes(b"123456789") == 0xE3069283
    assert scalar.crc32c_bytes(bytes(32)) == 0x8A9136AA
    assert scalar.fnv1a64_bytes(b"") == 0xCBF29CE484222325
    assert scalar.fnv1a64_bytes(b"a") == 0xAF63DC4C8601EC8C


def test_internal_keys_sort_and_split(spark):
    made = [(k, s) for k in (b"", b"a", b"a\0", b"a\0b", b"ab", b"\0", b"\xff") for s in (1, 7, 300)]
    df = spark.createDataFrame(made, "key binary, seq long").withColumn("ikey", scalar.ikey_encode(F.col("key"), F.col("seq")))
    found = {(bytes(r.key), r.seq): bytes(r.ikey) for r in df.collect()}
    assert found == {(k, s): scalar.ikey_bytes(k, s) for k, s in made}
    assert sorted(made, key=lambda m: found[m]) == sorted(made, key=lambda m: (m[0], -m[1]))
    assert all(scalar.ikey_split(found[m]) == m for m in made)


def test_null_is_unknown_in_sql_update(spark):
    made = sql.create(spark.createDataFrame([(1, 5), (2, None)], "k long, v long"), "k")
    assert sorted(rows(sql.read(sql.delete(made, "k", F.col("v") > 1), "k"))) == [(2, None)]
    assert sorted(rows(sql.read(sql.update(made, "k", F.col("v") > 1, v=F.lit(9)), "k")), key=str) == [(1, 9), (2, None)]
    assert sorted(rows(sql.read(sql.update(made, "k", F.col("v") > 1, v=F.lit(9)), "k", 1)), key=str) == [(1, 5), (2, None)]


def test_trace_lines_round_trip(spark, tmp_path):
    path = tmp_path / "plain-7.jsonl"
    path.write_text('{"seed":7,"unit":"ns"}\n{"seq":1,"t":50,"kind":"log","node":2,"event":"raft_commit","data":{"range_id":3,"server":2,"idx":9,"term":1,"decidedNs":40}}\n{"seq":2,"t":60,"kind":"send","node":1,"data":{"msgs":[{"range_id":3},{"range_id":4}]}}\n')
    lines = jsonl.read_trace(spark, str(path))
    assert rows(trace.view(lines, "raft_commit")) == [("plain-7", 1, 50, 40, 2, 3, 2, 9, 1)]
    assert sorted(r.seq for r in trace.carve(lines, 3).collect()) == [1, 2]
    assert [r.seq for r in trace.carve(lines, 4).collect()] == [2]
    jsonl.write_trace(lines, str(tmp_path / "out"))
    assert sorted(map(str, jsonl.read_trace(spark, str(tmp_path / "out")).collect())) == sorted(map(str, lines.collect()))
    assert jsonl.header(spark, str(path)).count() == 1


def test_registers_cover_every_event_and_wrong_reads_are_violations(spark):
    from tracelake.plans import measure_queries

    sf = "/root/testdata/sf0.01"
    history = measure_queries._registers(spark, sf).cache()
    assert history.count() == spark.read.parquet(f"{sf}/events.parquet").count()
    wrong = {r.key for r in history.filter(f"known and result = {measure_queries.WRONG}").select("key").distinct().collect()}
    flipped = {r.key for r in history.filter("known and op = 'cas' and pseq % 307 = 5").select("key").distinct().collect()}
    status = {r.key: r.status for r in measure_queries.lin_verdict(spark, sf).collect()}
    assert wrong and {status[k] for k in wrong} <= {"violation", "exhausted"} and "violation" in {status[k] for k in wrong}
    rest = {k: s for k, s in status.items() if k not in wrong | flipped}
    assert rest and set(rest.values()) <= {"ok", "exhausted"} and "ok" in rest.values()


def test_id_blocks_of_every_lineitem_row_take_several_tasks(spark):
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey").collect()
    sizes = [int(r.l_linenumber) for r in sorted(lines)]
    leases = spark.createDataFrame([(k + 1, k % 5, n) for k, n in enumerate(sizes)], "idx long, node long, size long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranges.id_blocks(leases).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    upto = 0
    want = {}
    for k, n in enumerate(sizes):
        want[k + 1] = (upto + 1, upto + n)
        upto += n
    assert {r.idx: (r.first_id, r.last_id) for r in found} == want and len(found) == len(lines) == 60_000
    assert len({r.task for r in found}) > 1
    grants = spark.createDataFrame([(i, a, b + (1 if i % 10_007 == 0 else 0), i) for i, (a, b) in want.items()], "idx long, first_id long, last_id long, seq long")
    bad = {(r.idx, r.what) for r in checks.ids_unique(grants).collect()}
    reach, over = 0, set()
    for i, (a, b) in want.items():
        if a <= reach:
            over.add((i, "overlap"))
        reach = max(reach, b + (1 if i % 10_007 == 0 else 0))
    assert bad == over and over


def test_state_keys_lie_in_their_spans(spark):
    last = (1 << 64) - 1
    for group, purpose in ((0, 0), (5, 3), (1 << 40, 4)):
        row = spark.range(1).select(replica.state_key(F.lit(group), F.lit(purpose), F.lit(b"applied")).alias("k")).first()
        key = bytes(row.k)
        assert len(key) == 31 and key.endswith(b"applied")
        for own in (replica.state_span(group), replica.state_span(group, purpose)):
            assert own[0] <= key < own[1]
        assert not replica.state_span(group, purpose + 1)[0] <= key and not replica.state_span(group + 1)[0] <= key
    assert replica.state_span(last)[1] == b"\0" * 7 + b"\x01" and replica.state_span(last, last)[1] == replica.state_span(last)[1]


def test_value_and_applied_index_are_of_one_version(spark):
    made = spark.createDataFrame([(1, 1, "a", "put", 10), (1, 2, "b", "put", 20), (1, 3, "a", "delete", None), (1, 4, "a", "noop", None)], "range_id long, idx long, key string, kind string, value long")
    reads = spark.createDataFrame([(k, 1, key, v) for k, (key, v) in enumerate([("a", 2), ("a", 3), ("b", 9), ("b", 1), ("a", 0)])], "read_id long, range_id long, key string, version long")
    assert sorted(rows(replica.reads_at(replica.apply_batches(made), reads).select("read_id", "value", "applied"))) == [(0, 10, 2), (1, None, 3), (2, 20, 4), (3, None, 1), (4, None, 0)]


def test_reads_wait_are_served_or_refused(spark):
    cols = "read_id long, range_id long, server long, first_of_term long, seq long, t long, lease_until long, able array<long>"
    reads = spark.createDataFrame([(1, 0, 1, 2, 10, 5, None, [2]), (2, 0, 1, 2, 10, 5, 6, []), (3, 0, 1, 2, 10, 5, None, []), (4, 0, 1, 9, 10, 5, 5, [2]), (5, 0, 1, 1, 11, 5, 4, [2, 3])], cols)
    acks = spark.createDataFrame([(1, 2, 12), (1, 3, 11), (1, 2, 9), (5, 7, 12)], "read_id long, server long, seq long")
    commits = spark.createDataFrame([(0, 1, 4, 8, 1), (0, 1, 3, 9, 1)], "range_id long, server long, idx long, seq long, t long")
    applies = spark.createDataFrame([(0, 1, k, 9 + k, 1) for k in range(1, 6)], "range_id long, server long, idx long, seq long, t long")
    found = {r.read_id: (r["index"], r.confirmed, r.served, r.fate) for r in replica.read_index(reads, acks, commits, applies, [1, 2, 3]).collect()}
    assert found == {1: (4, 11, 13, "served"), 2: (4, 10, 13, "served"), 3: (4, None, None, "refused"), 4: (9, 10, None, "unapplied"), 5: (4, None, None, "unconfirmed")}


def test_stale_lease_reads_are_those_that_are_not_linearizable(spark):
    reads = spark.createDataFrame([(1, 0, 1, 3, "x", 10), (2, 0, 1, 3, "y", 11), (3, 0, 2, 3, "x", 12), (4, 0, 3, 3, "x", 13)], "read_id long, range_id long, server long, term long, key string, seq long")
    revoked = spark.createDataFrame([(0, 2, 3, 12), (0, 1, 2, 1)], "range_id long, server long, term long, seq long")
    clocks = spark.createDataFrame([(1, 0), (2, 300), (3, 150)], "server long, drift_ppm long")
    risky = replica.lease_reads_at_risk(reads, revoked, clocks, 200)
    assert sorted(r.read_id for r in risky.collect()) == [1, 2]
    told = spark.createDataFrame([("x", "violation"), ("y", "ok")], "key string, status string")
    assert [(r.read_id, r.status) for r in replica.unsafe_lease_reads(risky, told).collect()] == [(1, "violation")]


def test_a_new_block_takes_the_place_of_the_old(spark):
    adopted = spark.createDataFrame([(1, 7, 6, 90, 99, 1), (1, 7, 7, 3, 4, 2), (1, 7, 7, 3, 4, 6), (1, 7, 7, 20, 29, 8)], "node long, run long, granted_run long, first_id long, last_id long, seq long")
    takes = spark.createDataFrame([(1, 7, s) for s in (0, 3, 4, 5, 7, 9)], "node long, run long, seq long")
    assert [r.id for r in replica.id_takes(adopted, takes).orderBy("seq").collect()] == [None, 3, 4, None, None, 20]


def test_journals_replay(spark, tmp_path):
    good = b"".join(echo.encode(k) for k in range(5))
    assert echo.replay(good) == (5, 0, False) and echo.replay(b"") == (0, 0, False)
    assert all(echo.replay(good[:at] + bytes([good[at] ^ 4]) + good[at + 1 :]) == (4, 1, False) for at in range(len(good)))
    (tmp_path / "journal").write_bytes(good[:-3])
    assert [(r.valid, r.corrupt, r.torn) for r in echo.read_journals(spark, str(tmp_path)).collect()] == [(4, 0, True)]


def test_evicting_takes_the_whole_entry(spark):
    owned = spark.createDataFrame([(0, 5, 1, 1), (5, 9, 1, 1), (9, 12, 2, 1), (20, 30, 1, 1)], "low long, high long, range_id long, generation long")
    misses = spark.createDataFrame([(7,), (15,)], "key long")
    assert sorted(rows(ranges.evict(owned, misses))) == [(9, 12, 2, 1), (20, 30, 1, 1)]


def test_a_trace_file_begins_with_its_header(spark, tmp_path):
    lines = spark.createDataFrame([("r", 1, 5, "log", 2, "raft_commit", None, '{"idx":3}')], trace.LINE)
    jsonl.write_trace(lines, str(tmp_path / "out"), {"seed": 42, "unit": "ns"})
    assert jsonl.read_trace(spark, str(tmp_path / "out")).count() == 1
    assert [r.header for r in jsonl.header(spark, str(tmp_path / "out")).collect()] == ['{"seed": 42, "unit": "ns"}']
    with pytest.raises(ValueError, match="seq"):
        jsonl.write_trace(lines, str(tmp_path / "bad"), {"seq": 1})


def test_gaps_show_only_while_they_last(spark):
    held = spark.createDataFrame([(1, 0, 10, 1, 5), (1, 0, 6, 5, None), (2, 6, 10, 8, None)], "range_id long, start long, stop long, from_seq long, to_seq long")
    commands = spark.createDataFrame([(9, k) for k in (0, 3, 6, 7, 8, 12)], "range_id long, seq long")
    assert sorted(rows(checks.tiling_after(held, commands, 0, 10))) == [(9, 0, 0), (9, 6, 6), (9, 7, 6)]


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_keys_in_spans_equal_brute_force(spark, how):
    draw = random.Random(5)

    def word() -> str:
        return "range/" + "".join(draw.choice("ab\0é𝄞z") for _ in range(draw.randrange(9)))

    keys = sorted({word() for _ in range(300)} | {"", "r", "range", "range/", "s", "\U0010ffff"})
    spans = [(word(), word()) for _ in range(60)] + [("range/b", "range/b"), ("range/ab", "range/ab\0")]
    spans = [(a, b) for a, b in spans if a >= b or len(a) > 2 and draw.random() < 0.5]
    rows_of = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key string, seq long")
    found = intervals.in_spans(rows_of, spark.createDataFrame([*spans, *spans[:3], ("x", None)], "start string, stop string"), how, only=F.col("seq") % 5 > 0)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    hit = {n for n, k in enumerate(keys) if n % 5 and any(a.encode() <= k.encode() < b.encode() for a, b in spans)}
    assert {r.seq for r in found.collect()} == (hit if how == "left_semi" else set(range(len(keys))) - hit)
    assert hit and len(hit) < len(keys)


def test_no_span_holds_no_key(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    none = spark.createDataFrame([("b", "a"), (None, "z")], "start string, stop string")
    assert intervals.in_spans(keys, none, "left_semi").count() == 0 and intervals.in_spans(keys, none, "left_anti").count() == 2


def test_a_reorder_is_an_apply_after_the_second_splits(spark):
    arms = spark.createDataFrame([(1, 7, 50, 30, 100), (2, 8, 50, 30, 100), (3, 9, 50, None, 0), (4, 6, 90, 70, 100)], "arm long, range_id long, first_cut long, second_cut long, since long")
    applies = spark.createDataFrame([
        (1, 5, 120, 7, 0, 30), (2, 6, 130, 7, 0, 50),  # the first split's update comes second
        (3, 7, 140, 8, 0, 50), (4, 8, 150, 99, 30, 50),  # in order; the right half tells the second
        (5, 4, 160, 8, 0, 50),  # an index below one applied before doesn't count
        (6, 9, 90, 6, 0, 70),  # before the arm: no time
    ], "seq long, idx long, t long, range_id long, start long, stop long")
    assert rows(measure.meta_reorders(applies, arms).orderBy("arm")) == [(1, 20, True), (2, 50, False), (3, None, False), (4, None, False)]


def test_split_fate_equals_brute_force(spark):
    draw = random.Random(9)
    asked = [(n, draw.randrange(3), draw.randrange(40)) for n in range(60)]
    splits = [(draw.randrange(3), draw.randrange(40), draw.randrange(1000)) for _ in range(40)]
    spans = [(draw.randrange(2), a := draw.randrange(40), a + draw.randrange(30), draw.randrange(1000)) for _ in range(25)]
    found = measure.split_fate(spark.createDataFrame(asked, "ask long, range_id long, cut long"), spark.createDataFrame(splits, "range_id long, split_at long, t long"), spark.createDataFrame(spans, "range_id long, start long, stop long, t long"))
    wanted = [(n, min((t for q, k, t in splits if (q, k) == (r, c)), default=None), min((t for q, a, b, t in spans if q == r and not a < c < b), default=None)) for n, r, c in asked]
    assert rows(found.orderBy("ask")) == wanted
