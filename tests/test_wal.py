"""The write-ahead-log codec: round trips, damage, superseding segments."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracelake.operators import kv
from tracelake.sources import wal, wal_sink

BATCHES = [[("put", b"a", b"1")], [("put", b"b", b""), ("delete", b"a", None)], [], [("delete", b"zz", None)], [("put", b"c", b"\0" * 300)]]


@pytest.mark.parametrize("batch", BATCHES)
def test_writes_round_trip(batch):
    data = wal.encode_writes(batch)
    assert wal.decode_writes(data) == batch
    if batch and batch[0][0] != "put" or len(batch) != 1:
        with pytest.raises(ValueError):
            wal.decode_writes(data + b"x")
    for bad in (b"", b"\x09", data[:3]):
        with pytest.raises(ValueError):
            wal.decode_writes(bad)


def test_damage_ends_a_segment():
    records = [wal.encode_record(k + 1, wal.encode_writes(b)) for k, b in enumerate(BATCHES)]
    whole = b"".join(records)
    assert [r[0] for r in wal.parse_records(whole)] == [1, 2, 3, 4, 5]
    for at in range(len(records[0]) + len(records[1]), len(whole)):
        found = list(wal.parse_records(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :]))
        assert found[-1][2] and [r[0] for r in found[:-1]] == list(range(1, len(found)))
        torn = list(wal.parse_records(whole[:at]))
        assert sum(r[2] for r in torn) == (at not in (sum(map(len, records[:k])) for k in range(6)))


def test_recovery_from_files(spark, tmp_path):
    first = b"".join(wal.encode_record(k, wal.encode_writes([("put", b"k%d" % k, b"old")])) for k in (1, 2, 3))
    second = b"".join(wal.encode_record(k, wal.encode_writes([("put", b"k%d" % k, b"new")])) for k in (3, 4, 6))
    (tmp_path / "000001.wal").write_bytes(first)
    (tmp_path / "000002.wal").write_bytes(second)
    log = wal.writes_of(wal.recovered_prefix(wal.read_segments(spark, str(tmp_path))))
    assert [(bytes(r.key), bytes(r.value)) for r in kv.scan_at(log).collect()] == [(b"k1", b"old"), (b"k2", b"old"), (b"k3", b"new"), (b"k4", b"new")]


def test_segments_written_by_tasks_read_back(spark, tmp_path):
    made = [(b"k%d" % (k % 7), k // 3 + 1, k % 3, "delete" if k % 5 == 0 else "put", None if k % 5 == 0 else b"v" * (k % 40)) for k in range(600)]
    log = spark.createDataFrame(made, "key binary, seq long, ord int, op string, value binary").repartition(5)
    path = str(tmp_path / "wal")
    wal_sink.write_segments(log, path, segment_bytes=500)
    names = sorted(p.name for p in (tmp_path / "wal").iterdir())
    assert len(names) > 5 and names[0] == f"{1:020d}.wal" and not any(n.startswith(".") for n in names)
    records = wal.read_segments(spark, path)
    assert records.filter("bad").count() == 0 and [r.seq for r in records.orderBy("segment", "offset").collect()] == list(range(1, 201))
    found = wal.writes_of(wal.recovered_prefix(records))
    want = sorted((k, s, o, op, v or b"" if op == "put" else None) for k, s, o, op, v in made)
    assert sorted((bytes(r.key), r.seq, r.ord, r.op, None if r.value is None else bytes(r.value)) for r in found.collect()) == want
    wal_sink.write_segments(log.filter("seq > 500"), path)  # nothing adds nothing
    assert sorted(p.name for p in (tmp_path / "wal").iterdir() if p.suffix == ".wal") == names


def test_a_missing_head_is_refused_or_discards_the_log(spark):
    rows = spark.createDataFrame([(0, k, False, "v") for k in (3, 4, 7)], "segment long, seq long, bad boolean, value string")
    assert [(r.expected, r.found) for r in kv.head_gap(rows, 1).collect()] == [(1, 3)] and kv.head_gap(rows, 3).count() == 0
    with pytest.raises(kv.HeadGap, match="expected record 1, found 3"):
        kv.recovered_from(rows, 1)
    assert kv.recovered_from(rows, 1, "discard").count() == 0
    assert sorted(r.seq for r in kv.recovered_from(rows, 3).collect()) == [3, 4]
    assert [r.seq for r in kv.recovered_from(rows, 4).collect()] == [4]  # what is flushed is ignored
    with pytest.raises(ValueError, match="no policy"):
        kv.recovered_from(rows, 1, "guess")
    assert kv.recovered_from(rows.limit(0), 1).count() == 0


def test_damaged_tables_are_told_by_what_they_hold(spark):
    log = spark.createDataFrame([(1, b"a", 3), (1, b"c", 9), (2, b"b", 4)], "number long, key binary, seq long")
    manifest = kv.described(log)
    assert kv.damaged_tables(manifest, kv.described(log)).count() == 0
    told = {(r.number, r.what) for r in kv.damaged_tables(manifest, kv.described(log.filter("number = 1").withColumn("seq", F.col("seq") + 1))).collect()}
    assert told == {(1, "versions"), (2, "missing")}
    assert [r.what for r in kv.damaged_tables(manifest.filter("number = 1"), kv.described(log.filter("seq <> 9"))).collect()] == ["entries"]
