"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import bpe, chat, common, components, exact_dedup, langid, licenses, matroska, mixing, near_copies, quality, queries, sharding, simhash

SF = "/root/testdata/sf0.001"
SPACES = rb"[^\x20\x09-\x0D]+"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, shard string, sha string, maybe string, fp string"
BASE = "the quick brown fox jumps over the lazy dog and runs away from the old house near the river bank at dawn"


def docs_of(spark, texts, ids=None, source="s"):
    """Documents, with extra columns whose names clash with those that operators add."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \t\n", "a", "A", "b c", BASE, BASE, BASE.upper(), BASE + " x", "word " * 30_000, "é中文 \0 ok", "ALPHA beta", "alpha BETA", "é", "É"]
    return docs_of(spark, texts).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_report(none, labels).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_dedup(none).count() == 0
    assert langid.language_report(none).count() == 0 and langid.keep_identified(none).count() == 0
    assert sharding.shard_documents(spark, none).count() == 0
    assert matroska.media_features(matroska.to_media(none)).count() == 0
    assert licenses.license_matches(none).count() == 0
    assert exact_dedup.dedup_report(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0
    assert mixing.mix_report(none).count() == 0 and mixing.mix_documents(none).count() == 0
    assert bpe.encode_digest(none, RANKS, public_tokenizers.PATTERN).count() == 0
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted_digest(chat.format_conversations(talk, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


# 1: quality


def test_quality_held_out_accuracy(spark):
    found = queries.QUERIES["op1_quality"](spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    right = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.97
    assert found.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.quality_report(docs, x).select("doc_id", "score").orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_quality_odd_texts(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (6, 1, 0), (6, 0, 0), (7, None, 0), (None, 1, 0), (9, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.score for r in quality.quality_report(odd, labels).collect()}
    assert len(found) == 16 and all(0 <= s <= 1 for s in found.values()) and found[0] == found[1] and found[6] == found[7]
    alone = quality.quality_report(odd, labels.filter("quality = 1")).select("score").distinct().collect()
    assert len(alone) == 1 and alone[0][0] > 0.5


def test_dual_coordinate_descent_separates():
    random = np.random.default_rng(0)
    samples = [np.array([0, 2 + k % 3]) if k % 2 else np.array([1, 2 + k % 3]) for k in range(60)]
    labels = np.array([k % 2 for k in range(60)])
    weights, bias = quality.dual_coordinate_descent(samples, labels, random.uniform(0.5, 1, 5))
    assert all((weights[s].sum() + bias > 0) == bool(y) for s, y in zip(samples, labels, strict=True))


# 2: SimHash


def slow_fingerprint(text: str | None) -> int:
    words = re.findall(SPACES, (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(fps: dict[int, int], bits: int = 3) -> dict[int, int]:
    parent = {d: d for d in fps}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in fps}


def test_simhash_fingerprints_match_spark_hash(spark, odd):
    texts = {r.doc_id: r.text for r in odd.collect()}
    found = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    fps = {d: slow_fingerprint(t) for d, t in texts.items()}
    assert {d: r.fp & (2**64 - 1) for d, r in found.items()} == fps
    assert {d: r.component_id for d, r in found.items()} == slow_components(fps)
    one = spark.sql("SELECT xxhash64('fox jumps over') AS h").first().h & (2**64 - 1)
    assert one == slow_fingerprint("fox jumps over")


def test_links_by_grid_equal_brute_force(spark):
    random = np.random.default_rng(4)
    centres = random.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(c) for c in centres} | {int(c) ^ sum(1 << int(b) for b in random.choice(64, random.integers(1, 6), replace=False)) for c in centres for _ in range(12)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = slow_components({f: f & (2**64 - 1) for f in signed})
    for small, block, groups in ((16, 1024, None), (2, 3, None), (16, 1024, 9)):  # the second sends almost all cells through blocks
        got = {r.node: r.root for r in components.connected_components(simhash.links(nodes, small=small, block=block, groups=groups)).collect()}
        assert {f: got.get(f, f) for f in signed} == want


def test_manhattan_bound_is_below_hamming(spark):
    random = np.random.default_rng(1)
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in random.integers(-(1 << 63), 1 << 63, (200, 2), dtype=np.int64)], "a long, b long")
    found = pairs.select(simhash.differing(simhash.unary_counts(F.col("a")), simhash.unary_counts(F.col("b"))).alias("low"), simhash.differing(F.col("a"), F.col("b")).alias("high"), "a", "b").collect()
    for r in found:
        counts = [[(x >> (2 * k) & 3).bit_count() for k in range(32)] for x in (r.a & (2**64 - 1), r.b & (2**64 - 1))]
        assert r.low == sum(abs(x - y) for x, y in zip(*counts, strict=True)) <= r.high


def test_near_dedup_keeps_one_of_each(spark):
    docs = docs_of(spark, [BASE, BASE, "other text here today", None, "", BASE, "y z w", "y z w q r s t"], [5, 4, 7, 9, 8, 4, 7, None])
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in simhash.near_dedup(docs).select("doc_id", "text").collect()) == [(-1, "y z w q r s t"), (4, BASE), (7, "other text here today"), (7, "y z w"), (8, "")]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (3, 2)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 120)}


# 3: language


def test_language_held_out_accuracy(spark):
    found = queries.QUERIES["op3_language"](spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98


def test_language_distance_is_out_of_place():
    import pandas as pd

    def grams(text):
        out = Counter()
        for word in re.findall("[a-zé]+", text.lower()):
            w = f" {word} ".encode()
            out.update(w[k : k + n] for n in (1, 2, 3) for k in range(len(w) - n + 1) if w[k : k + n] != b" ")
        return out

    def ranks(text):
        return {g: k for k, (g, _) in enumerate(sorted(grams(text).items(), key=lambda x: (-x[1], len(x[0]), x[0]))[: langid.PROFILE_SIZE])}

    code = lambda g: len(g) << 24 | int.from_bytes(g, "big")
    sample = {"xx": "the then there", "yy": "être été thé"}
    learned = pd.DataFrame([(lang, code(g), r) for lang, t in sample.items() for g, r in ranks(t).items()], columns=["lang", "code", "rank"])
    texts = ["There the other", "thé 9 été!", "", "zz"]
    found = langid.Profiles(learned).distances([t.encode() for t in texts])
    for k, text in enumerate(texts):
        own = ranks(text)
        for j, lang in enumerate(sorted(sample)):
            there = ranks(sample[lang])
            want = sum(abs(there[g] - r) if g in there else langid.PROFILE_SIZE for g, r in own.items()) / (max(len(own), 1) * langid.PROFILE_SIZE)
            assert found[k, j] == pytest.approx(want)


def test_undetermined(spark, odd):
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_report(odd).collect()}
    assert {d for d, (lang, _) in found.items() if lang == "und"} == {0, 1, 2}
    assert all(score == 0 for lang, score in found.values() if lang == "und") and all(0 <= s <= 1 for _, s in found.values())
    assert {r.doc_id for r in langid.keep_identified(odd).collect()} == set(range(3, 16))
    untaught = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_report(untaught).collect()} == {"und"}


# 4: sharding


def test_shards_are_exact_and_gapless(spark):
    docs = docs_of(spark, ["t"] * 50 + [f"text {k}" for k in range(53)] + [None, ""], list(range(50)) + [k % 20 for k in range(53)] + [1, None])
    found = sharding.shard_documents(spark, docs).toPandas()
    counts = found.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert len(found) == 105 and len(counts) == 8 and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()
    assert Counter(zip(found["size"], found["text_crc32"], strict=True)) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in [r.text for r in docs.collect()])
    assert found.equals(sharding.shard_documents(spark, docs.repartition(5)).toPandas()) or set(map(tuple, found.fillna(-1).to_numpy().tolist())) == set(map(tuple, sharding.shard_documents(spark, docs.repartition(5)).toPandas().fillna(-1).to_numpy().tolist()))


def test_hypergeometric_law(spark):
    n = 4000
    for good, bad, sample in ((50, 70, 30), (3, 900, 400), (700, 20, 350), (5, 5, 9)):
        df = spark.range(n).select(sharding.hypergeometric(F.lit(good).cast("long"), F.lit(bad).cast("long"), F.lit(sample).cast("long"), F.col("id")).alias("k"))
        k = np.array([r.k for r in df.collect()])
        pop = good + bad
        mean, var = sample * good / pop, sample * good / pop * bad / pop * (pop - sample) / (pop - 1)
        assert k.min() >= max(0, sample - bad) and k.max() <= min(good, sample)
        assert abs(k.mean() - mean) < 5 * (var / n) ** 0.5 and 0.85 * var < k.var() < 1.15 * var
    edge = spark.range(1).select(*[sharding.hypergeometric(*[F.lit(x).cast("long") for x in t], F.lit(1)) for t in ((0, 5, 3), (5, 0, 3), (5, 4, 0), (5, 4, 9))]).first()
    assert tuple(edge) == (0, 3, 0, 5)


def test_matrix_has_its_margins(spark):
    parts = spark.createDataFrame([(k, n) for k, n in enumerate([5, 0, 17, 900, 1])], "part int, n long")
    sizes = [231, 231, 231, 230]
    found = {r.part: list(r.sends) for r in sharding.communication_matrix(parts, sizes, 3).collect()}
    assert {p: sum(s) for p, s in found.items()} == {0: 5, 1: 0, 2: 17, 3: 900, 4: 1}
    assert [sum(s[j] for s in found.values()) for j in range(4)] == sizes


def test_sharding_runs_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = sharding.exact_shuffle(docs.select("doc_id"), 3)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 5: Matroska


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 4095, 4096, 4097, 32768, 131072, 131073, 300_000])
def test_media_round_trip(size):
    payload = matroska.padded(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes())
    data = matroska.mux(payload)
    media = matroska.parse(data)
    assert matroska.payload_of(data, media) == payload and media.complete and media.doc_type == "matroska" and len(payload) % 64 == 0
    assert media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8
    assert [p[1] for p in media.packets] == [k * 512_000_000 for k in range(len(media.packets))]
    assert [data[c[2] : c[2] + 4] for c in media.cues] == [b"\x1f\x43\xb6\x75"] * media.clusters


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_lacing_and_unknown_sizes(kind):
    frames = [b"x" * n for n in ((600, 3, 255, 0, 70) if kind != 2 else (9, 9, 9))]
    if kind == 1:
        lace = b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    else:
        lace = matroska.ebml_lace([len(f) for f in frames]) if kind == 3 else b""
    body = b"\x82" + struct.pack(">h", -5) + bytes([kind << 1, len(frames) - 1]) + lace + b"".join(frames)
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, body) + matroska.uint_element(matroska.REFERENCE_BLOCK, 1))
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    cluster = b"\x1f\x43\xb6\x75" + unknown + matroska.uint_element(matroska.TIMESTAMP, 100) + group
    data = matroska.HEADER + b"\x18\x53\x80\x67" + unknown + cluster + cluster + matroska.element(matroska.CUES, b"")
    media = matroska.parse(data)
    assert media.complete and media.clusters == 2 and [p[3] for p in media.packets] == [len(f) for f in frames] * 2
    assert {p[0] for p in media.packets} == {2} and {p[1] for p in media.packets} == {95_000_000} and not any(p[4] for p in media.packets)
    assert matroska.payload_of(data, media, 2) == b"".join(frames) * 2


def test_damaged_media():
    data = matroska.mux(bytes(10_000))
    for cut in (0, 3, 41, len(data) // 2, len(data) - 1):
        assert matroska.parse(data[:cut]).complete == (cut == 0)
    assert not matroska.parse(b"\0\0\0").complete


def test_media_query(spark, odd):
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    media = matroska.to_media(odd)
    for r in matroska.media_features(media).collect():
        payload = matroska.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    packets = matroska.packet_table(media)
    assert packets.groupBy("doc_id").agg(F.sum("byte_size")).count() == 16
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "doc_id long, media binary")
    assert matroska.packet_table(broken).count() == 0


# 6: licenses


def slow_matches(text: str | None, templates: dict[str, str]) -> dict[str, float]:
    own = licenses.words((text or "").encode())
    out = {}
    for name, template in templates.items():
        words = licenses.words(template.encode())
        width = min(5, len(words))
        want = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
        have = {tuple(own[k : k + width]) for k in range(len(own) - width + 1)}
        if len(want & have) / len(want) >= 0.8:
            out[name] = len(want & have) / len(want)
    return out


def test_license_matches_equal_brute_force(spark):
    mit = licenses.TEMPLATES["MIT"]
    cut = mit.split()
    texts = [None, "", "short", mit, BASE + " " + mit + " " + BASE, " ".join(cut[:-3]), " ".join(cut[: len(cut) // 2]), "Licensed under CC BY-NC 4.0.", "x\nReleased under the MIT License.\ny", mit + "\n" + licenses.TEMPLATES["Apache-2.0-header"], "w " * 5000 + licenses.TEMPLATES["GPL-3.0-header"], mit.upper().replace(",", " ;;")]
    texts += [f"{BASE} " * k + licenses.TEMPLATES["ISC"] for k in range(12)]
    docs = docs_of(spark, texts)
    found: dict = {}
    for r in licenses.license_matches(docs).collect():
        found.setdefault(r.doc_id, {})[r.license] = r.containment
        assert r.first_word < r.end_word
    assert found == {k: m for k, t in enumerate(texts) if (m := slow_matches(t, licenses.TEMPLATES))}
    assert licenses.license_matches(docs, {}).count() == 0
    assert {r.doc_id for r in licenses.license_matches(docs, {"one": "CC BY-NC"}).collect()} == {7}


# 7: exact dedup


def test_exact_dedup_equals_groups(spark):
    texts = ["A", "a", None, "", "é", "É", "b", "b", "a", "long " * 9000, "LONG " * 9000, "alone"]
    ids = [3, 9, 5, None, 1, 2, 4, 4, 9, 7, 8, 6]
    docs = docs_of(spark, texts, ids)
    norm = [(t or "").encode().lower() for t in texts]
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup_report(docs).collect()), key=str)
    best = {n: max((i for i, m in zip(ids, norm, strict=True) if m == n and i is not None), default=None) for n in norm}
    seen, want = set(), []
    for i, n in zip(ids, norm, strict=True):
        kept = i == best[n] and n not in seen
        seen |= {n} if kept else set()
        want.append((i, best[n], norm.count(n), kept, hashlib.sha256(n).hexdigest()))
    assert found == sorted(want, key=str)
    stay = exact_dedup.exact_dedup(docs)
    assert stay.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "").encode().lower()) for r in stay.collect()) == sorted((i, n) for (i, _, _, k, _), n in zip(want, norm, strict=True) if k)


def test_full_filter_changes_nothing(spark):
    docs = docs_of(spark, [f"t{k % 300}" for k in range(500)])
    a = sorted(map(tuple, exact_dedup.dedup_report(docs, max_slots=1 << 6).collect()))
    assert a == sorted(map(tuple, exact_dedup.dedup_report(docs).collect()))


def test_filter_lets_most_single_rows_pass(spark):
    hashes = exact_dedup.text_hashes(docs_of(spark, [f"t{k}" for k in range(3000)]), "doc_id", "text")
    assert exact_dedup._repeats(hashes, spark.sparkContext.broadcast(exact_dedup.repeated_filter(hashes))).filter("maybe").count() < 60


def test_fewer_probes_where_the_filter_is_small(spark):
    assert [exact_dedup.best_probes(rows, 1 << 20) for rows in (1 << 16, 1 << 18, 1 << 20, 1 << 22)] == [4, 3, 1, 1]
    hashes = exact_dedup.text_hashes(docs_of(spark, [f"t{k}" for k in range(2000)]), "doc_id", "text")
    few = exact_dedup.repeated_filter(hashes, max_slots=1 << 11)
    assert few.probes == 1 and exact_dedup._repeats(hashes, spark.sparkContext.broadcast(few)).filter("maybe").count() < 1500


def test_few_single_rows_shuffle_where_the_filter_takes_parts(spark):
    """4 parts of 2**15 slots for 8192 rows; one filter of so many slots would send some 15 %."""
    texts = [f"t{k}" for k in range(7000)] + ["Hot"] * 700 + [f"p{k % 246}" for k in range(492)]
    docs, slots = docs_of(spark, texts).repartition(5), 1 << 15
    assert exact_dedup.filter_parts(len(texts), slots) == 4
    hashes = common.shared_checkpoint(exact_dedup.text_hashes(docs, "doc_id", "text"))
    marks = exact_dedup.marked(hashes, slots)
    assert marks.count() == len(texts)
    assert marks.filter("id < 7000 and maybe").count() < 70 and marks.filter("id >= 7000 and not maybe").count() == 0
    whole = marks.sparkSession.sparkContext.broadcast(exact_dedup.routing_filter(hashes, slots))
    told = exact_dedup._repeats(hashes, whole)
    assert told.filter("id < 7000 and maybe").count() < 70 and told.filter("id >= 7000 and not maybe").count() == 0
    assert sorted(map(tuple, exact_dedup.dedup_report(docs, max_slots=slots).collect())) == sorted(map(tuple, exact_dedup.dedup_report(docs).collect()))
    stay = {r.doc_id for r in exact_dedup.exact_dedup(docs, max_slots=slots).collect()}
    assert stay == {max(i for i, t in enumerate(texts) if t == own) for own in set(texts[7000:])} | set(range(7000))


def test_parts_of_the_filter_grow_with_the_rows():
    assert [exact_dedup.filter_parts(rows, 1 << 29) for rows in (0, 1, 1 << 25, (1 << 25) + 1, 10**9, 10**11)] == [1, 1, 1, 2, 32, 4096]


# 8: mixing


def test_targets_share_and_stop():
    found = mixing.targets({"b": 100, "a": 1000, None: 10})
    assert found == {"a": Fraction(1665) - 200 - 20, "b": Fraction(200), None: Fraction(20)}
    assert sum(mixing.targets({"x": 7, "y": 9, "z": 20}).values()) == Fraction(54)
    assert mixing.targets({"x": 0}) == {"x": 0}


def test_mix_meets_its_targets(spark):
    random = np.random.default_rng(3)
    rows = [(k, " ".join(["w"] * int(n)) if n else None, ["a", "b", "c", "d", None][int(s)]) for k, (n, s) in enumerate(zip(random.integers(0, 120, 900), random.choice(5, 900, p=[0.1, 0.2, 0.4, 0.2, 0.1]), strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_report(docs).collect()
    size = {k: len(re.findall(SPACES, (t or "").encode())) for k, t, _ in rows}
    source = {k: s for k, _, s in rows}
    whole = Counter()
    for k, s in source.items():
        whole[s] += size[k]
    want, taken = mixing.targets(dict(whole)), Counter()
    assert len(found) == 900
    for r in found:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == whole[s] and r.target == pytest.approx(float(want[s])) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in whole:
        assert abs(taken[s] - float(want[s])) <= max(0.01 * float(want[s]), 3)
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix_report(docs.repartition(7)).collect()))
    copies = Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    assert all(copies[r.doc_id] == r.copies for r in found)


def test_mix_odd_rows(spark, odd):
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in mixing.mix_report(odd).collect():
        assert r.size == len(re.findall(SPACES, (texts[r.doc_id] or "").encode()))
    again = docs_of(spark, ["a b", "a b", "c", None], [1, 1, 1, None])
    assert mixing.mix_report(again).count() == 4 and mixing.mix_documents(again).columns == again.columns


# 9: BPE


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("limits", [None, (200, 40, 30)])
def test_bpe_equals_the_library(spark, odd, reference, monkeypatch, limits):
    if limits:  # many chunks, words forgotten between them, and the heap for long words
        monkeypatch.setattr(bpe, "CHUNK_BYTES", limits[0])
        monkeypatch.setattr(bpe, "MAX_WORDS", limits[1])
        monkeypatch.setattr(bpe, "LONG_PIECE", limits[2])
    extra = ["<|endoftext|> I'll we've x  \n\n y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "ÀÉ٠١Ⅷ²½ 北京大学生 😀😀", "don't  stop   now", "thouhe$$$ nding*** xqzjv\x1c\x85"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: list(r.token_ids) for r in encoded.collect()} == {d: reference.encode_ordinary(t) for d, t in texts.items()}
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(encoded, RANKS).collect()} == texts
    for r in bpe.encode_digest(docs, RANKS, public_tokenizers.PATTERN).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_chunks_in_one_worker(reference, monkeypatch):
    """The Python sides without Spark, with the fold replaced by the library: chunk bounds and forgotten words."""
    import pyarrow as pa

    vocabulary = bpe.load_vocabulary(RANKS)
    shared = SimpleNamespace(value=vocabulary)
    texts = [f"zzqx{k} vvbn{k % 7} thouherion{k}" for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    back = {c: chr(b) for b, c in enumerate(vocabulary.chars.tolist())}

    def fold(part):
        words = [None if w is None else "".join(bpe.token_char(i) for i in reference._core_bpe.encode_single_piece(w.translate(back).encode("latin-1"))) for w in part.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.string()), part.column(3), part.column(4)], part.schema.names)

    monkeypatch.setattr(bpe, "CHUNK_BYTES", 1)
    monkeypatch.setattr(bpe, "MAX_WORDS", 30)
    batches = [batch.slice(k, 5) for k in range(0, 50, 5)]
    out = [r for b in bpe._gathered(shared)(map(fold, bpe._cut(shared, public_tokenizers.PATTERN)(iter(batches)))) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert dict(out) == {k: reference.encode_ordinary(t) for k, t in enumerate(texts)}


def test_merges_of_words_are_the_tokens_inside_them():
    vocabulary = bpe.load_vocabulary(RANKS)
    words = [b"thouherion", b"", b"a", b"\xc3\xa9\xff\x00", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", bytes(range(256))]
    found = vocabulary.trie.merges(words).to_pylist()
    assert found == [sorted({vocabulary.ranks[w[i:j]] for i in range(len(w)) for j in range(i + 2, len(w) + 1) if w[i:j] in vocabulary.ranks}) for w in words]
    assert vocabulary.trie.merges([]).to_pylist() == []


def test_ranks_that_merges_cannot_make_are_refused():
    bytes_only = [bytes([b]) for b in range(256)]
    assert bpe.merge_pairs([*bytes_only, b"ab", b"abc"])[-2:] == [(97, 98), (256, 99)]
    with pytest.raises(ValueError, match="isn't made by merges"):
        bpe.merge_pairs([*bytes_only, b"abc", b"ab"])


OTHER_PATTERN = r"""(?i:'s|'t)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+"""


def test_bpe_with_another_pattern(spark):
    vocabulary = bpe.load_vocabulary(RANKS)
    other = tiktoken.Encoding("other", pat_str=OTHER_PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    texts = ["Hello, world's (ok) 1234 x", "naïve — \n\n 'T", "中文 abc"]
    found = {r.doc_id: list(r.token_ids) for r in bpe.encode(docs_of(spark, texts), RANKS, OTHER_PATTERN).collect()}
    assert found == {k: other.encode_ordinary(t) for k, t in enumerate(texts)}


def test_quick_cuts_equal_the_pattern():
    random = np.random.default_rng(5)
    whole = regex.compile(public_tokenizers.PATTERN).findall
    pool = [chr(c) for c in range(256)] + list(" '  \n\n''ssttrevemlld  aé1²") * 6
    for _ in range(400):
        text = "".join(random.choice(pool, 80))
        assert bpe.splitter(public_tokenizers.PATTERN)(text) == whole(text)
    assert public_tokenizers.PATTERN == bpe.COMMON_PATTERN


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text UNION ALL SELECT 2L, cast(X'C3' AS string)")
    found = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    assert found == {1: "a\ufffdb".encode(), 2: "\ufffd".encode()}
    assert bpe.encode_digest(docs, RANKS, public_tokenizers.PATTERN).count() == 2


def test_heap_merges_equal_the_library(reference):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    random = np.random.default_rng(9)
    for _ in range(200):
        piece = bytes(random.choice(np.frombuffer(b"aabbthe =\xc3\xa9", np.uint8), random.integers(2, 300)))
        if piece not in ranks:
            assert bpe.heap_merges(piece, ranks) == reference._core_bpe.encode_single_piece(piece)


# 10: chat


def test_chat_masks(spark):
    hard = ["\\", "<|", "<|end|>", "\\<|turn|>", "<", "|>", " lead", "trail ", "\n\n", "é中😀", "", None, "a" * 4000, "<|endoftext|>"]
    talks = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hard)] + [(2, k, "assistant", t) for k, t in enumerate(hard)] + [(3, 0, "user", "only"), (None, 0, "assistant", "x"), (4, None, None, "q"), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (5, 0, "assi<|text|>stant", "z")]
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(3)
    found = {r.conv_id: r for r in chat.formatted_digest(chat.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for conv in {t[0] for t in talks}:
        own = sorted((t for t in talks if t[0] == conv), key=order)
        told = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        learned = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_escapes_are_undone():
    for text in ["\\", "<|", "\\<|", "<\\|", "\\\\<|x|>", "<|turn|>a<|text|>b<|end|>", "\n\\\n"]:
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_mask_by_binary_search_equals_overlap():
    starts, ends = np.array([0, 3, 3, 5, 9]), np.array([3, 5, 5, 9, 12])
    spans = np.array([[1, 2], [4, 4], [5, 10]])
    want = [any(a < e and s < b for a, b in spans if a < b) for s, e in zip(starts, ends, strict=True)]
    assert chat.mask_tokens(starts, ends, spans[spans[:, 0] < spans[:, 1]]).tolist() == want


# the pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, reference):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {d: r for d, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    last = {}
    for d, r in kept.items():
        key = r.text.encode().lower()
        last[key] = max(d, last.get(key, d))
    kept = {d: kept[d] for d in last.values()}
    comps = slow_near_copies({d: r.text for d, r in kept.items()})
    kept = {d: r for d, r in kept.items() if comps[d] == d}
    found = corpus_pipeline.run(spark, SF).collect()
    sizes = {d: len(re.findall(SPACES, r.text.encode())) for d, r in kept.items()}
    whole, taken = Counter(), Counter()
    for d, r in kept.items():
        whole[r.source] += sizes[d]
    for r in found:
        taken[kept[r.doc_id].source] += sizes[r.doc_id]
        ids = reference.encode_ordinary(kept[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].text.encode()).hexdigest()
    assert max(Counter(r.doc_id for r in found).values()) <= 2
    for s, want in mixing.targets(dict(whole)).items():
        assert abs(taken[s] - float(want)) <= max(0.02 * float(want), 60)


# near copies of the pipeline


def slow_sets(texts: dict[int, str]) -> dict[int, set[bytes]]:
    out = {}
    for d, t in texts.items():
        words = re.findall(SPACES, (t or "").encode().lower())
        out[d] = {b" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    return out


def slow_near_copies(texts: dict[int, str]) -> dict[int, int]:
    sets = slow_sets(texts)
    least = {d: d for d in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and sets[a]))]
    while True:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def edited(random, words: list[str], n: int) -> list[str]:
    out = list(words)
    for k in random.choice(len(out), n, replace=False):
        out[k] = f"new{random.integers(1 << 40)}"
    return out


@pytest.mark.parametrize(("small", "block"), [(16, 256), (2, 3)])
def test_near_copies_equal_brute_force_at_jaccard(spark, small, block):
    random = np.random.default_rng(8)
    texts = [None, "", " \n", "a b", "A  b", "a b c"]
    for g in range(6):
        base = [f"w{g}x{random.integers(1 << 30)}" for _ in range(150)]
        texts += [" ".join(edited(random, base, n)) for n in (0, 1, 2, 2, 3, 5, 9, 30)]
    base = [f"hot{k}" for k in range(200)]
    texts += [" ".join(edited(random, base, n)) for n in (1, 2, 3, 4, 6) for _ in range(8)]
    docs = docs_of(spark, texts)
    found = {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs, small=small, block=block).collect()}
    want = slow_near_copies(dict(enumerate(texts)))
    assert found == want and 6 < len(set(want.values())) < len(texts)


def test_near_copies_are_found_by_simhash_alone(spark, monkeypatch):
    """Without any agreement of minima, the grid of segment popcounts still names copies within three bits; those below 0.8 stay apart."""
    monkeypatch.setattr(near_copies, "band_minima", lambda hashes, at: np.arange((len(at) - 1) * near_copies.BANDS, dtype=np.uint64).reshape(-1, near_copies.BANDS) + near_copies.mix(hashes[at[:-1]])[:, None])
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(reversed(words)), " ".join(words[:250])]
    fps = near_copies.set_fingerprints(*near_copies.shingle_sets([t.encode() for t in texts]))
    hashes, at = near_copies.shingle_sets([t.encode() for t in texts])
    for k, fp in enumerate(fps.tolist()):
        own = [int(h) for h in near_copies.mix(hashes[at[k] : at[k + 1]])]
        assert fp == sum((2 * sum(h >> b & 1 for h in own) > len(own)) << b for b in range(64))
    assert (int(fps[0]) ^ int(fps[1])).bit_count() <= 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, r.component_id) for r in near_copies.near_duplicates(docs).collect()) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_the_pipeline_drops_near_copies_beyond_three_bits(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    random = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    docs = docs_of(spark, [" ".join(base), " ".join(edited(random, base, 2)), " ".join(edited(random, base, 12))])
    assert slow_components({r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}) == {0: 0, 1: 1, 2: 2}
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()) == [0, 2]
    again = docs_of(spark, [BASE, BASE, "other text here today", None, "", BASE, "y z w", "y z w q r s t"], [5, 4, 7, 9, 8, 4, 7, None])
    kept = Counter(r.doc_id for r in corpus_pipeline.near(spark, again, SF).collect())
    assert kept == Counter([None, 4, 7, 7, 8])


def test_pipeline_near_stage_equals_brute_force_at_jaccard(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = corpus_pipeline.exact(spark, corpus_pipeline.language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), SF)
    comps = slow_near_copies({r.doc_id: r.text for r in docs.collect()})
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()) == sorted(d for d, c in comps.items() if c == d)


def test_language_ranks_counts_beyond_the_packed_key():
    import pandas as pd

    learned = pd.DataFrame([("xx", 1 << 24 | ord("b"), 0)], columns=["lang", "code", "rank"])
    text = b"a " * ((1 << 20) + 50) + b"b " * ((1 << 20) + 90)
    found = langid.Profiles(learned).distances([text, b"a b b"])
    assert found[:, 0].tolist() == pytest.approx([7 / 8, 7 / 8])


# every operator


def long_text(seed: int, words: int) -> str:
    random = np.random.default_rng(seed)
    pool = ["".join(random.choice(list("abcdeéÉXY.,9"), random.integers(1, 9))) for _ in range(700)]
    return "  ".join(np.array(pool)[random.integers(0, 700, words)].tolist()) + "\n"


def test_long_texts_give_what_short_ones_give(monkeypatch):
    """A text alone in its block goes run by run; with an empty one beside it, in one piece."""
    text = long_text(1, 9000).encode()
    notice = licenses.TEMPLATES["MIT"].encode()
    licensed = b" ".join([text, notice, text, licenses.TEMPLATES["ISC"].encode(), text])
    monkeypatch.setattr(common.pieces, "__defaults__", (5000,))
    for module in (quality, simhash, near_copies):
        monkeypatch.setattr(module, "BLOCK_BYTES", 5000)
    assert len(list(common.pieces(text))) > 5 and b"".join(common.pieces(text)) == text and list(common.pieces(b"")) == [b""]
    assert quality.features([text])[1].tolist() == quality.features([text, b""])[1].tolist()
    assert simhash.fingerprints([text])[0] == simhash.fingerprints([text, b""])[0] == slow_fingerprint(text.decode())
    for alone, beside in zip(near_copies.shingle_sets([text]), near_copies.shingle_sets([text, b""]), strict=True):
        assert alone.tolist() == beside[: len(alone)].tolist()
    for alone, beside in zip(langid.counted_ngrams([text]), langid.counted_ngrams([text, b""]), strict=True):
        assert alone.tolist() == beside.tolist()
    matcher = licenses.Matcher(licenses.TEMPLATES)
    monkeypatch.setattr(licenses, "RUN_WORDS", 512)
    assert matcher.scan([licensed]) == matcher.scan([licensed, b""]) and {m[1] for m in matcher.scan([licensed])} == set(slow_matches(licensed.decode(), licenses.TEMPLATES)) >= {"MIT", "ISC"}
    one = b"x" * 30_000  # one long word
    assert quality.features([one])[1].tolist() == quality.features([one, b""])[1].tolist() and simhash.fingerprints([one])[0] == slow_fingerprint(one.decode())


def test_long_texts_are_cut_into_the_same_pieces(monkeypatch):
    text = long_text(2, 4000) + " don't\n\n  x" * 50
    cut = bpe.splitter(public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "LONG_TEXT", 1000)
    assert [p for lot in bpe.cuts(text, cut, public_tokenizers.PATTERN) for p in lot] == cut(text)


NAMES = ["lang_pred", "lang_score", "component_id", "root", "slot", "shard", "size", "target", "copies", "media", "mix_id", "mix_nth", "taken", "n", "lot", "id", "word", "number", "merges", "odd_id", "a.b", "with `tick"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns that bear the names operators use, and names that are no plain identifiers."""
    texts = [BASE, BASE.upper(), BASE + " x y", "la maison et le chien", None, "", "1 2 3", "b c d e f", BASE]
    rows = [(k, t, "en", "s", len(t or ""), *(f"{n}{k}" for n in NAMES)) for k, t in enumerate(texts)]
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in NAMES)])
    return spark.createDataFrame(rows, kinds).repartition(2)


@pytest.mark.parametrize("stage", [langid.keep_identified, exact_dedup.exact_dedup, simhash.near_dedup, near_copies.near_dedup, mixing.mix_documents])
def test_stages_keep_columns_of_any_name(clashing, stage):
    made = stage(clashing)
    assert made.columns == clashing.columns
    whole = set(map(tuple, clashing.collect()))
    found = list(map(tuple, made.collect()))
    assert found and set(found) <= whole


def test_reports_take_columns_of_any_name(spark, clashing):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (3, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_report(clashing, labels).count() == langid.language_report(clashing).count() == simhash.near_duplicates(clashing).count() == 9
    assert matroska.media_features(matroska.to_media(clashing)).count() == exact_dedup.dedup_report(clashing).count() == mixing.mix_report(clashing).count() == 9
    assert bpe.encode_digest(clashing, RANKS, public_tokenizers.PATTERN).count() == sharding.shard_documents(spark, clashing).count() == 9
    assert licenses.license_matches(clashing).count() == 0
    shuffled = sharding.exact_shuffle(clashing, 2)
    assert shuffled.columns == [*clashing.columns, "shard_", "slot_"] and {r.shard for r in shuffled.collect()} == {f"shard{k}" for k in range(9)}
    odd_names = clashing.select(F.col("doc_id").alias("the.id"), F.col("text").alias("the.text"), "source")
    assert exact_dedup.exact_dedup(odd_names, "the.id", "the.text").count() == 6
    assert mixing.mix_report(odd_names, "the.id", "source", "the.text").count() == simhash.near_duplicates(odd_names, "the.id", "the.text").count() == 9
    with pytest.raises(ValueError, match="lang_pred"):
        langid.identify(clashing, langid.learn_profiles(clashing.select("lang", "text")))


@pytest.mark.parametrize("stage", ["language", "exact", "near", "mix", "tokens"])
def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, none, clashing, stage):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    run = getattr(corpus_pipeline, stage)
    for docs in (odd, none, clashing, odd.unionByName(odd)):
        found = run(spark, docs, SF)
        assert stage == "tokens" or found.columns == docs.columns
        assert found.count() <= 2 * docs.count() and (docs is none) == (found.count() == 0)


def test_bytes_that_are_not_utf8_go_through_every_operator(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'61FF6220C3' AS string) AS text, 'en' AS lang, 's' AS source UNION ALL SELECT 5L, 'a b c d', 'en', 's'")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for made in (quality.quality_report(docs, labels), langid.language_report(docs), simhash.near_duplicates(docs), near_copies.near_duplicates(docs), exact_dedup.dedup_report(docs), mixing.mix_report(docs), sharding.shard_documents(spark, docs), matroska.media_features(matroska.to_media(docs)), bpe.encode_digest(docs, RANKS, public_tokenizers.PATTERN)):
        assert made.count() == 2
    talk = docs.selectExpr("doc_id AS conv_id", "0L AS turn", "text AS role", "text")
    found = {r.conv_id: r for r in chat.formatted_digest(chat.format_conversations(talk, public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    assert len(found) == 2 and found[1].n_turns == 1


def test_conversations_without_id_stay_apart(spark):
    talk = spark.createDataFrame([(None, 0, "assistant", f"t{k}") for k in range(5)], "conv_id long, turn long, role string, text string")
    found = chat.formatted_digest(chat.format_conversations(talk, public_tokenizers.path("byte_bpe_50k.json"))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in found] == [(None, 1, 2)] * 5


@pytest.mark.parametrize("seed", range(60))
def test_damaged_media_never_raises(seed):
    random = np.random.default_rng(seed)
    data = bytearray(matroska.mux(matroska.padded(random.integers(0, 256, 9000, dtype=np.uint8).tobytes())))
    head = data.index(b"\x1f\x43\xb6\x75") + 40
    for at in random.integers(0, head if seed % 2 else len(data), 6):
        data[at] = random.choice([0, 1, 0x3F, 0x7F, 0x80, 0xFF, random.integers(256)])
    media = matroska.parse(bytes(data))
    assert all(-(1 << 63) <= p[1] < 1 << 63 and p[0] is not None for p in media.packets)
    matroska.features(matroska.payload_of(bytes(data), media), media)


def test_floats_and_times_of_impossible_width():
    info = matroska.element(matroska.INFO, matroska.element(matroska.DURATION, b"\x40\x00"))
    assert not matroska.parse(matroska.HEADER + matroska.element(matroska.SEGMENT, info)).complete
    late = matroska.element(matroska.CLUSTER, matroska.element(matroska.TIMESTAMP, b"\xff" * 8) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\0\0\x80x"))
    found = matroska.parse(matroska.HEADER + matroska.element(matroska.SEGMENT, late))
    assert not found.complete and found.packets == []


def test_class_counts_equal_brute_force(spark):
    rows = [("spam spam buy NOW!!", 0), ("spam buy", 0), ("a quiet text", 1), ("quiet quiet words here", 1), ("buy a text", 1)]
    ratios, classes = quality.log_count_ratios(spark.createDataFrame(rows, "text string, label int").repartition(3))
    counts = np.ones((2, quality.FEATURES))
    for text, label in rows:
        for feature in set(quality.features([text.encode()])[1].tolist()):
            counts[label, feature] += 1
    want = np.log(counts[1] / counts[1].sum() / (counts[0] / counts[0].sum()))
    assert classes.tolist() == [2, 3] and np.allclose(ratios, want)


def slow_features(text: bytes) -> set[int]:
    """Byte runs, hashed one by one."""
    return {int(quality._hashed(np.array([int.from_bytes(text[k : k + n], "big")]), n)[0]) for n in (1, 2, 3) for k in range(len(text) - n + 1)}


def test_byte_features_equal_brute_force():
    texts = [b"abc ab", b"", b"\xff\x00x", b"aaaa"]
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    bounds = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    text, found = (np.concatenate(x) for x in quality.byte_features(buf, np.repeat(np.arange(4), np.diff(bounds)), bounds))
    assert [set(found[text == k].tolist()) for k in range(4)] == [slow_features(t) for t in texts]


def test_dual_descent_meets_the_optimum():
    """The hinge loss's dual optimum, against projected gradient on the whole dual."""
    random = np.random.default_rng(1)
    samples = [np.sort(random.choice(12, random.integers(2, 6), replace=False)) for _ in range(40)]
    labels = np.array([int(0 in s or 1 in s) for s in samples])
    labels[:3] ^= 1
    scale = random.uniform(0.3, 2, 12)
    rows = np.zeros((40, 13))
    for k, s in enumerate(samples):
        rows[k, s] = scale[s] / np.linalg.norm(scale[s])
    rows[:, 12] = 1
    signed = rows * np.where(labels, 1, -1)[:, None]
    share = np.bincount(labels, minlength=2) / 40
    top = np.where(labels == 1, 0.5 / share[1], 0.5 / share[0])
    alpha, gram = np.zeros(40), signed @ signed.T
    for _ in range(20_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, top)
    weights, bias = quality.dual_coordinate_descent(samples, labels, scale, epochs=3000)
    assert np.allclose(weights / scale, (alpha @ signed)[:12], atol=0.02) and abs(bias - (alpha @ signed)[12]) < 0.02


def test_mixing_rates_solve_the_dual(spark):
    """Multipliers by bisection on the whole table, and copies that follow the tilted rates."""
    random = np.random.default_rng(6)
    rows = [(k, ["a", "b", "c"][k % 3], int(random.integers(1, 60)) * (1 + 3 * (k % 3))) for k in range(1200)]
    sizes, means = Counter(), {}
    for _, s, n in rows:
        sizes[s] += n
    for s in sizes:
        means[s] = sizes[s] / 400
    want = mixing.targets(dict(sizes))
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    histogram = frame.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    found = mixing.multipliers(histogram, want, dict(sizes), means)
    copies = {r.doc_id: r.copies for r in mixing.document_copies(frame).collect()}
    for s in sizes:
        own = np.array([n for _, t, n in rows if t == s], float)
        if want[s] >= 2 * sizes[s]:
            assert found[s] == float("inf") and all(copies[k] == 2 for k, t, _ in rows if t == s)
            continue
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (np.minimum(2, np.exp(mid * own / means[s])) * own).sum() < float(want[s]) else (low, mid)
        assert found[s] == pytest.approx(low, abs=1e-4)
        rate = np.minimum(2, np.exp(low * own / means[s]))
        got = np.array([copies[k] for k, t, _ in rows if t == s], float)
        assert np.all(np.abs(got - rate) <= 2) and abs((got * own).sum() - float(want[s])) <= 3
        order = np.argsort(own)
        for part in np.array_split(order, 4):  # small and large documents alike follow the rates
            assert abs((got[part] * own[part]).sum() / (rate[part] * own[part]).sum() - 1) < 0.12


def test_equal_rows_are_dealt_to_all_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_DOCS", 50)
    frame = spark.createDataFrame([(7, "a", 10)] * 600 + [(k, "b", 5) for k in range(400)], "doc_id long, source string, size long")
    made = mixing.document_copies(frame)
    found = made.collect()
    assert Counter((r.doc_id, r.source) for r in found)[7, "a"] == 600 and len(found) == 1000
    words = Counter()
    for r in found:
        words[r.source] += r.copies * r.size
    want = mixing.targets({"a": 6000, "b": 2000})
    assert all(abs(words[s] - float(want[s])) <= 150 for s in want)
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.document_copies(frame.repartition(9)).collect()))


def test_every_row_reaches_every_shard_alike(spark):
    hits = np.zeros((24, 3))
    docs = spark.range(24).toDF("doc_id")
    for seed in range(60):
        for r in sharding.exact_shuffle(docs, 3, seed=seed).collect():
            hits[r.doc_id, r.shard] += 1
    assert (hits.sum(axis=0) == 60 * 8).all()
    assert ((hits - 20) ** 2 / 20).sum() < 48 + 5 * (2 * 48) ** 0.5  # chi square of 48 degrees


def test_near_copies_put_only_close_fingerprints_in_the_grid(spark):
    sims = [0, 0b111, (1 << 63) - 1, 0x5555555555555555, 0x5555555555555555]
    nodes = spark.createDataFrame([(k, v, [100 + k] * 2) for k, v in enumerate(sims)], "fp long, sim long, bands array<long>")
    cells = near_copies._cells(nodes, 6).collect()
    assert {c.fp for c in cells if c.band < 20} == {0, 1, 3, 4}  # the third has no other within three bits
    assert sorted((c.band, c.fp) for c in cells if c.band >= 20) == [(b, k) for b in (20, 21) for k in range(5)]
