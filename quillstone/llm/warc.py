"""WARC archives: a writer of one gzip member a record, and a splittable reader.

The reader deals byte ranges of the files to tasks. A task looks for gzip magic in its range, takes a candidate as a
record only if the member inflates to a WARC header, its gzip CRC holds and what follows it is another member or the
end of the file, and owns the records that start inside its range, reading past the range's end where the last one does.

Edge cases: null html is an empty payload; null urls are written as urn:absent; a null page_id has no number in its
record and comes back null; rows with equal page_id and payload are all responses if theirs is the largest; an empty
table gives no archive and an empty result; other input columns are ignored; a record of any length is read whole by the
task that owns its start.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import settle, shared_path, table

REVISIT_FROM = 1000
SPLIT_BYTES = 8 << 20
MOST_TASKS = 1 << 15
_MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 18
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, record_offset long"


def with_record_types(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to of each page."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = pages.select("page_id", "url", "html", F.octet_length(raw).cast("long").alias("payload_bytes"), F.sha1(raw).alias("payload_digest"))
    shared = (
        sized.where(F.col("payload_bytes") >= revisit_from)
        .groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
        .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    found = sized.join(shared, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return found.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _uri(url: str | None) -> str:
    return "".join(f"%{b:02X}" if b <= 32 or b >= 127 else chr(b) for b in (url or "urn:absent").encode())


def record_bytes(page_id: int | None, url: str | None, html: str | None, digest: str, kind: str, refers_to: int | None, level: int = 6) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(level, wbits=31)
    return z.compress("\r\n".join(head).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/part-{context.partitionId():06d}.warc.gz"
        attempt, out, size, records = f"{path}.attempt-{context.taskAttemptId()}", None, 0, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "payload_digest", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(attempt, compression=None)
                member = record_bytes(*(c[i].as_py() for c in cols))
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:  # a task that runs again writes the same file again; the move makes it appear whole or not at all
            out.close()
            try:
                store.move(attempt, path)
            except OSError:
                if store.get_file_info(path).type != fs.FileType.File:
                    raise
                store.delete_file(attempt)  # another attempt was first; its records are the same
            yield pa.RecordBatch.from_pydict({"archive": [path.rsplit("/", 1)[1]], "bytes": pa.array([size], pa.int64()), "records": pa.array([records], pa.int64())})

    return write


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of with_record_types() as archives into folder, one a task; returns (archive, bytes, records)."""
    return settle(records.select("page_id", "url", "html", "payload_digest", "record_type", "refers_to").mapInArrow(_writer(folder), "archive string, bytes long, records long"), "warc-manifest")


def inflate_member(read: Callable[[int, int], bytes], at: int, size: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at `at` if it is whole, its CRC holds and it holds a WARC record; else None."""
    z, parts, checked, pos = zlib.decompressobj(wbits=31), [], False, at
    try:
        while not z.eof:
            chunk = read(pos, min(_STEP, size - pos))
            if not chunk:
                return None
            pos += len(chunk)
            parts.append(z.decompress(chunk))
            if not checked and (got := b"".join(parts)[:5]) and (len(got) == 5 or z.eof):
                if got != b"WARC/":
                    return None
                checked = True
    except zlib.error:
        return None
    end = pos - len(z.unused_data)
    if end < size and read(end, min(3, size - end)) != _MAGIC[: size - end]:
        return None
    return b"".join(parts), end


def _number(record_id: str) -> int | None:
    tail = record_id.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def parse_record(content: bytes) -> dict:
    """The fields of _READ_SCHEMA but the archive's; fails if a response's payload doesn't match its digest."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _number(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": None if refers is None else _number(refers), "url": fields["WARC-Target-URI"]}


def read_range(read: Callable[[int, int], bytes], size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, fields) of the records that start in [start, end)."""
    end = min(end, size)
    held = read(start, min(end + len(_MAGIC) - 1, size) - start)
    at = held.find(_MAGIC)
    while 0 <= at < end - start:
        member = inflate_member(read, start + at, size)
        if member is None:
            at = held.find(_MAGIC, at + 1)
            continue
        yield start + at, parse_record(member[0])
        at = held.find(_MAGIC, member[1] - start)


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in _READ_SCHEMA.split(", ")]
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in _READ_SCHEMA.split(", ")]

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for job in batch.to_pylist():
                with store.open_input_file(f"{base}/{job['archive']}") as f:
                    rows: list[dict] = []
                    for offset, fields in read_range(lambda at, n, f=f: f.read_at(n, at), job["bytes"], job["start"], job["start"] + job["length"]):
                        rows.append(fields | {"archive": job["archive"], "record_offset": offset})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return read_all


def read_archives(manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives of a manifest (archive, bytes), read by ranges of split_bytes."""
    step = F.lit(split_bytes).cast("long")
    ranges = manifest.select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("start")).withColumn("length", step)
    tasks = min(max(ranges.count(), 1), MOST_TASKS)  # a fixed number, as their few bytes would else be read by one task
    return ranges.repartition(tasks).mapInArrow(_reader(folder), _READ_SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    manifest = write_archives(with_record_types(table(spark, sf_dir, "pages")), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN first IS NOT NULL AND p.page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND p.page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes = g.payload_bytes
"""
