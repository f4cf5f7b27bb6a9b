import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.llm import mixing, sharding


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Water-filling by rounds, as the law is stated."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / (sum(w[s] for s in free) or 1)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_law(spark, make):
    rows = [(i, "w " * (1 + i * 7 % 23), "en", ["hot", "hot", "hot", "b", "c", None, "e"][i * i % 7]) for i in range(600)]
    got = mixing.mix(make(rows, clash=True), rows_per_slice=16).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    wanted, most = targets(dict(sizes)), max(r["size"] for r in got)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(wanted[r["source"]], rel=1e-9)
        taken[r["source"]] += r["taken"]
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= most / 2 + 1e-6
    assert len(got) == 600
    again = mixing.mix(make(rows[::-1]).repartition(5), rows_per_slice=64).collect()
    assert Counter((r["doc_id"], r["copies"]) for r in again) == Counter((r["doc_id"], r["copies"]) for r in got)


def test_mix_prefers_quality(make):
    rows = [(i, "w w w", "en", "abcdefgh"[i % 8]) for i in range(800)]
    got = mixing.mix(make(rows), F.when(F.col("doc_id") % 16 < 8, F.lit(1.0)).otherwise(F.lit(0.05))).where("target < source_size").collect()
    high, low = (sum(r["copies"] for r in got if (r["doc_id"] % 16 < 8) == side) for side in (True, False))
    assert high > 2 * low


def test_mix_brute_force(make):
    from hashlib import md5

    rows = [(i, "w " * (1 + i % 9), "en", "ab"[i % 2]) for i in range(200)]
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(make(rows), rows_per_slice=8).collect()}
    wanted = targets({"a": sum(1 + i % 9 for i in range(0, 200, 2)), "b": sum(1 + i % 9 for i in range(1, 200, 2))})
    for k, source in enumerate("ab"):
        docs = range(k, 200, 2)
        size = sum(1 + i % 9 for i in docs)
        key = lambda i: -math.log((int(md5(f"{mixing.SEED}:{i}:mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)
        epochs, before = int(wanted[source] // size), 0
        for i in sorted(docs, key=key):
            assert got[i] == epochs + (before + (1 + i % 9) / 2 < wanted[source] - epochs * size)
            before += 1 + i % 9


def test_mix_odd(make, odd_rows):
    assert mixing.mix(make(odd_rows, clash=True)).count() == len(odd_rows)
    assert mixing.mix(make([])).count() == 0
    assert mixing.mix(make([None, ""])).agg(F.sum("taken")).first()[0] == 0


def test_quality_of_repeated_labels(spark, make):
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["_quality"] for r in mixing.with_quality(make(["a", "b", "c", "d"]), labels).collect()}
    assert got == {0: 1.0, 1: 0.25, 2: 0.5, 3: 0.5}


def test_shards(make):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None) for i in range(1000)]
    got = sharding.interleave(make(rows, clash=True), rows_per_slice=32).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(24)) and {len(v) for v in by.values()} <= {41, 42}
    share = Counter(r["source"] for r in got)
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
        here = Counter(r["source"] for r in v)
        assert all(abs(here[s] - n * len(v) / 1000) <= 2.5 for s, n in share.items())
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.interleave(make(rows[::-1]).repartition(3), rows_per_slice=512).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}


def test_shards_brute_force(make):
    from hashlib import md5

    rows = [(i, f"t{i}", "en", "ab"[i % 3 == 0]) for i in range(60)]
    u = lambda i: (int(md5(f"{sharding.SEED}:{i}:row".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    placed = []
    for source in "ab":
        docs = sorted((i for i in range(60) if rows[i][3] == source), key=u)
        placed += [((k + 0.5) / len(docs), "=" + source, u(i), i) for k, i in enumerate(docs)]
    order = [i for *_, i in sorted(placed)]
    got = sorted(sharding.interleave(make(rows)).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in got] == order
    assert [r["shard"] for r in got] == [k * 24 // 60 for k in range(60)]


def test_shards_odd(make, odd_rows):
    got = sharding.interleave(make(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert sharding.interleave(make([])).count() == 0
    assert {(r["shard"], r["slot"]) for r in sharding.interleave(make(["same"] * 50)).collect()} == {(k * 24 // 50, k - -(-(k * 24 // 50) * 50 // 24)) for k in range(50)}


def test_op10_columns(spark, sf_dir):
    got = sharding.op10_sharding(spark, sf_dir).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "rows" and r["grown_shard"] is None
