import gzip
import hashlib
import io
import random

import pytest

from quillstone.llm import warc
from quillstone.llm.shared import shared_path


def expected(pages):
    best = {}
    for i, _, html in pages:
        p = (html or "").encode()
        if len(p) >= 1000 and i is not None:
            best[p] = max(best.get(p, i), i)
    out = []
    for i, _, html in pages:
        p = (html or "").encode()
        first = best.get(p)
        again = first is not None and first != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [warc.SPLIT_BYTES, 700])
def test_round_trip(spark, split):
    rng = random.Random(3)
    big = "<p>" + "é" * 600 + "</p>"
    pages = [(i, f"http://x/{i}", "".join(rng.choice("abc<>é \n") for _ in range(rng.choice([0, 5, 999, 1000, 5000])))) for i in range(80)]
    pages += [(100 + i, None, big) for i in range(30)] + [(200, "http://ä b", None), (201, "", ""), (None, "n", "x"), (129, "again", big), (None, None, big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_archives(warc.with_record_types(df), folder)
    got = warc.read_archives(manifest, folder, split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == expected(pages)
    total = manifest.agg({"records": "sum", "bytes": "sum"}).first()
    assert total[1] == len(pages) or total[0] == len(pages)


def test_reader_skips_false_magic():
    good = [warc.record_bytes(i, "u", f"page {i} " * 50, hashlib.sha1((f"page {i} " * 50).encode()).hexdigest(), "response", None) for i in range(5)]
    fake = gzip.compress(b"no warc header") + b"\x1f\x8b\x08junk"
    data = b"".join(good[:2]) + fake + b"".join(good[2:])
    read = lambda at, n: data[at : at + n]
    for step in (37, 500, len(data)):
        found = [f["page_id"] for start in range(0, len(data), step) for _, f in warc.read_range(read, len(data), start, start + step)]
        assert found[0] == 0 and set(found) >= {0, 2, 3, 4} and len(found) == len(set(found))


def test_records_are_gzip_members():
    data = b"".join(warc.record_bytes(i, "http://x", "html", hashlib.sha1(b"html").hexdigest(), "response", None) for i in range(3))
    text = gzip.GzipFile(fileobj=io.BytesIO(data)).read().decode()
    assert text.count("WARC/1.1\r\n") == 3 and text.count("HTTP/1.1 200 OK") == 3


def test_damage_is_found():
    record = bytearray(warc.record_bytes(1, "u", "x" * 2000, hashlib.sha1(b"y").hexdigest(), "response", None))
    with pytest.raises(ValueError):
        list(warc.read_range(lambda at, n: bytes(record[at : at + n]), len(record), 0, len(record)))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = shared_path(spark, "warc-empty")
    assert warc.read_archives(warc.write_archives(warc.with_record_types(df), folder), folder).count() == 0


def test_many_tasks_read_the_ranges(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    df = spark.createDataFrame([(i, "u", "".join(chr(rng.randrange(33, 1000)) for _ in range(3000))) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    folder = shared_path(spark, "warc-ranges")
    got = warc.read_archives(warc.write_archives(warc.with_record_types(df), folder), folder, 20_000).select("page_id", F.spark_partition_id().alias("task")).collect()
    assert sorted(r["page_id"] for r in got) == list(range(60)) and len({r["task"] for r in got}) > 8


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", "x" * 2000, "a", 5), (2, "u", "x" * 2000, "b", 6)], "page_id long, url string, html string, _first string, payload_bytes int")
    assert sorted(map(tuple, warc.with_record_types(df).select("page_id", "payload_bytes", "record_type", "refers_to").collect())) == [(1, 2000, "revisit", 2), (2, 2000, "response", None)]
