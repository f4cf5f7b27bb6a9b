import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import flac


def both(payloads):
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in payloads])]).astype(np.int64)
    return flac.encode(np.frombuffer(b"".join(payloads), np.uint8), offsets)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=300), st.binary(min_size=1, max_size=5).map(lambda b: b * 2000)), min_size=1, max_size=5))
def test_round_trip(payloads):
    media = both(payloads)
    assert flac.decode(media) == payloads
    for m, p in zip(media, payloads, strict=True):
        blocks = list(flac.decode_blocks(m))
        assert b"".join(x for _, x in blocks) == p and [o for o, _ in blocks] == list(range(0, len(p), flac.BLOCK))


def test_extremes():
    rng = np.random.default_rng(2)
    cases = [bytes(4096), b"\x00\xff" * 5000, rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes(), bytes(5000) + b"\xff" + bytes(5000), b"", b"x", bytes(range(256)) * 64]
    media = both(cases)
    assert flac.decode(media) == cases
    assert len(media[0]) < 900 and len(media[2]) < 21_500


def test_seeking():
    data = bytes(range(256)) * 100
    m = both([data])[0]
    assert [(o, p == data[o : o + flac.BLOCK]) for o, p in flac.decode_blocks(m, 9000, 13_000)] == [(8192, True), (12288, True)]


def test_damage_is_found():
    m = both([b"hello world " * 900])[0]
    for at in (0, 30, len(m) // 2, len(m) - 1):
        bad = bytearray(m)
        bad[at] ^= 8
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])


def bits(*fields):
    n = sum(k for k, _ in fields)
    v = 0
    for k, x in fields:
        v = v << k | (x & ((1 << k) - 1))
    pad = -n % 8
    return (v << pad).to_bytes((n + pad) // 8, "big")


def by_hand(samples, *subframe):
    """A stream of one frame, built field by field."""
    head = b"\xff\xf8\x74\x02\x00" + (len(samples) - 1).to_bytes(2, "big")
    frame = head + bytes([flac.crc8(head)]) + bits(*subframe)
    frame += int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    md5 = hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    info = bytes(10) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big") + md5
    seek = bytes(16) + len(samples).to_bytes(2, "big")
    return b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + frame


def rice(k, e):
    u = e * 2 if e >= 0 else -e * 2 - 1
    return (u >> k) + 1 + k, 1 << k | (u & ((1 << k) - 1))


def test_subframes_built_by_hand():
    plus = lambda x: bytes(v + 128 for v in x)
    assert flac.decode([by_hand([-7] * 20, (8, 0), (8, -7))]) == [plus([-7] * 20)]
    verbatim = [3, -128, 127, 0] * 5
    assert flac.decode([by_hand(verbatim, (8, 2), *[(8, v) for v in verbatim])]) == [plus(verbatim)]
    x = [i * i // 3 - 20 for i in range(16)]
    e = [x[i] - 3 * x[i - 1] + 3 * x[i - 2] - x[i - 3] for i in range(3, 16)]
    assert flac.decode([by_hand(x, (8, 0b001011 << 1), *[(8, v) for v in x[:3]], (2, 0), (4, 0), (4, 1), *[rice(1, v) for v in e])]) == [plus(x)]
    coefs, shift = [13, -5, 1], 3
    e = [x[i] - ((13 * x[i - 1] - 5 * x[i - 2] + x[i - 3]) >> shift) for i in range(3, 16)]
    fields = [(8, 0b100010 << 1), *[(8, v) for v in x[:3]], (4, 5), (5, shift), *[(6, c) for c in coefs], (2, 0), (4, 1), (4, 2), *[rice(2, v) for v in e[:5]], (4, 0), *[rice(0, v) for v in e[5:]]]
    assert flac.decode([by_hand(x, *fields)]) == [plus(x)]


def test_foreign_subframes():
    plus = lambda x: bytes(v + 128 for v in x)
    x = [i * 5 % 64 - 32 for i in range(16)]
    fixed = [(8, 0b001001 << 1), (8, x[0])]
    e = [b - a for a, b in zip(x[:-1], x[1:], strict=True)]
    assert flac.decode([by_hand(x, *fixed, (2, 1), (4, 0), (5, 3), *[rice(3, v) for v in e])]) == [plus(x)]
    assert flac.decode([by_hand(x, *fixed, (2, 0), (4, 0), (4, 15), (5, 8), *[(8, v) for v in e])]) == [plus(x)]
    mixed = [(2, 0), (4, 1), (4, 2), *[rice(2, v) for v in e[:7]], (4, 15), (5, 7), *[(7, v) for v in e[7:]]]
    assert flac.decode([by_hand(x, *fixed, *mixed)]) == [plus(x)]
    assert flac.decode([by_hand([7] * 16, (8, 0b001001 << 1), (8, 7), (2, 0), (4, 0), (4, 15), (5, 0))]) == [plus([7] * 16)]
    wasted = [4 * v for v in range(-8, 8)]
    assert flac.decode([by_hand(wasted, (8, 0b001001 << 1 | 1), (2, 1), (6, -8), (2, 0), (4, 0), (4, 0), *[rice(0, 1)] * 15)]) == [plus(wasted)]
    assert flac.decode([by_hand(wasted, (8, 3), (2, 1), *[(6, v // 4) for v in wasted])]) == [plus(wasted)]


def without_points(m):
    info, size = m[4:42], int.from_bytes(m[43:46], "big")
    return b"fLaC\x80" + info[1:] + m[46 + size :]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 30_000))
def test_streams_without_seek_table(seed, size):
    rng = np.random.default_rng(seed)
    data = rng.choice(np.array([0, 248, 255, 128], np.uint8), size).tobytes()
    m = without_points(both([data])[0])
    assert flac.decode([m]) == [data]
    assert [o for o, _ in flac.decode_blocks(m)] == list(range(0, size, flac.BLOCK))


def test_long_payloads_in_bounded_pieces():
    import tracemalloc

    data = np.frombuffer((b"some long text, %d " * 1_500_000) % tuple(range(1_500_000)), np.uint8)[: 24 << 20]
    offsets = np.array([0, len(data)])
    tracemalloc.start()
    media = flac.encode(data, offsets)
    assert tracemalloc.get_traced_memory()[1] < 4 * len(data)
    tracemalloc.reset_peak()
    assert flac.decode(media) == [data.tobytes()]
    assert tracemalloc.get_traced_memory()[1] < 4 * len(data) + 128 * flac.DECODED_TOGETHER
    tracemalloc.stop()


def test_crc16_is_that_of_the_format():
    assert int(flac.crc16(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0]) == 0xFEE8


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in flac.op3_flac(spark, sf_dir).collect():
        t = texts[r["doc_id"]]
        p = t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), flac.feature_of(p))
        m = both([p])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())


def test_odd(spark, make, odd_rows):
    from pyspark.sql import functions as F

    rows = make(odd_rows).select("doc_id", F.lit(0).cast("long").alias("n_bytes"), flac.payload(F.col("text")).alias("payload"))
    back = flac.decode_media(flac.encode_payloads(rows))
    assert back.count() == len(odd_rows) and back.where("length(payload) % 64 != 0 OR length(payload) = 0").count() == 0
    assert flac.encode_payloads(rows.withColumn("payload", F.lit(None).cast("binary"))).count() == len(odd_rows)
    assert flac.decode_media(flac.encode_payloads(rows.limit(0))).count() == 0
    assert flac.pcm_blocks(flac.encode_payloads(rows)).where("doc_id = 5").count() == -(-len(odd_rows[6][1].encode()) // flac.BLOCK) 


def test_stored_blocks(spark, make, odd_rows):
    from pyspark.sql import functions as F

    media = flac.encode_payloads(make(odd_rows, clash=True).select("doc_id", F.lit(0).cast("long").alias("n_bytes"), flac.payload(F.col("text")).alias("payload")))
    rows = flac.media_blocks(media).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    got = flac.measure_blocks(rows).collect()
    wanted = []
    for _, text, *_ in odd_rows:
        t = (text or "").encode()
        p = t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))
        wanted.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), flac.feature_of(p)))
    assert sorted(tuple(r)[4:] for r in got) == sorted(wanted)
    assert flac.measure_blocks(rows.limit(0)).count() == 0
    offsets = flac.pcm_blocks(media).where("doc_id = 5").orderBy("sample_offset").collect()
    assert b"".join(bytes(r["pcm"]) for r in offsets).rstrip(b"\0") == odd_rows[6][1].encode()
    assert [r["sample_offset"] for r in offsets] == [i * flac.BLOCK for i in range(len(offsets))]


def test_rounds_take_every_row(spark, make, odd_rows):
    from pyspark.sql import functions as F

    from quillstone.llm.shared import row_keys

    rows = row_keys(make(odd_rows)).select("doc_id", F.lit(0).cast("long").alias("n_bytes"), flac.payload(F.col("text")).alias("payload"), "_file", "_row")
    one, three = (flac.measure_blocks(flac.stored_blocks(rows, n)).collect() for n in (1, 3))
    assert sorted(map(str, one)) == sorted(map(str, three)) and len(one) == len(odd_rows)
    assert flac.measure_blocks(flac.stored_blocks(rows.limit(0), 2)).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.binary(max_size=60))
def test_feature_by_hand(pcm):
    x = [b - 128 for b in pcm]
    changes = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
    assert flac.feature_of(pcm) == f"{-(-len(x) // flac.BLOCK)}:{sum(map(abs, x))}:{sum(v * v for v in x)}:{changes}"
