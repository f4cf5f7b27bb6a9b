"""Secret scans with a recursive decoding worklist.

A text is layer 0. Every layer is scanned for secrets, then unwrapped: lines with URL or Unicode escapes, base64 runs
(over several lines, at each of the four places where an encoding glued to other letters can begin) read as UTF-8 or
UTF-16, and gzip or zlib data among the bytes of either, all members, whose content is inflated. Each result is a new
layer unless the same content from the same places was seen before, which ends cycles; the worklist runs until no layer
is left. Every character of a layer knows the stretch of the original text it came from, so spans always refer to the
original. Bytes that are no UTF-8 become characters of their own, so what stands beside them is scanned.

Inflated content is scanned in windows that overlap by as much as an encoded run at their end is long, so a small text
can't fill the memory and no run of up to 64 MB is cut.

Kinds and patterns are in KINDS. Spans are of whole matches in code points, end exclusive.

Edge cases: null and empty texts have no spans; equal spans found in several layers count once; rows that repeat are
scanned each; of spans of one kind that start together the shorter comes first; very long texts are scanned whole, one at
a time; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import table

KINDS = ("assign", "access", "hex")
# The patterns of the kinds and the lengths they need.
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run is whole from its first character on, so shorter ones needn't match
_RUN = r"[A-Za-z0-9+/_-]"
_BASE64 = re.compile(rf"{_RUN}{{16,}}(?:\r?\n[ \t]*{_RUN}{{4,}})*")  # lines of one encoding are one run
_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BYTE = re.compile(rb"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})")
_TOKEN = re.compile(r"\S*(?:%|\\x|\\u00)[0-9A-Fa-f]{2}\S*")
_GZIP, _ZLIB = b"\x1f\x8b\x08", re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_WINDOW, _OVERLAP, _LONGEST = 1 << 22, 1 << 16, 1 << 26
_STANDARD = str.maketrans("-_", "+/", "\r\n \t")
_SPANS = "array<struct<kind: string, start: long, end: long, path: string>>"


class Layer:
    """Text and where each character came from: starts and ends in the original, one number for all characters of inflated data, None for the original itself."""

    __slots__ = ("text", "starts", "ends", "path")

    def __init__(self, text: str, starts: array | int | None, ends: array | int | None, path: str):
        self.text, self.starts, self.ends, self.path = text, starts, ends, path

    def start(self, i: int) -> int:
        s = self.starts
        return i if s is None else s if isinstance(s, int) else s[i]

    def end(self, i: int) -> int:
        """The end of character i."""
        e = self.ends
        return i + 1 if e is None else e if isinstance(e, int) else e[i]

    def identity(self) -> tuple:
        """Names the content and the places it came from; equal layers hold equal spans."""
        content = hashlib.sha256(self.text.encode(errors="surrogatepass")).digest()
        if isinstance(self.starts, int):
            return content, self.starts, self.ends
        places = hashlib.sha256(self.starts)
        places.update(self.ends)
        return content, places.digest()


def scan(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the secrets in one layer."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(2, *m.span()) for m in _HEX.finditer(text)]
    return out


def _unescape(e: str) -> str | None:
    """The character of one escape other than percent signs."""
    digits = e[2:].strip("{};xX") if e[0] == "\\" else e[2:-1]
    code = int(digits.lstrip("xX"), 16 if e[0] == "\\" or e[2] in "xX" else 10)
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None


def _characters(raw: bytes) -> list[tuple[str, int]]:
    """(character, bytes) of bytes read as UTF-8, one that isn't as Latin-1."""
    return [(chr(ord(c) - 0xDC00), 1) if 0xDC80 <= ord(c) <= 0xDCFF else (c, len(c.encode())) for c in raw.decode(errors="surrogateescape")]


def _lines(layer: Layer) -> Iterator[Layer]:
    """Lines with escapes, unescaped once."""
    text, path = layer.text, f"{layer.path}/escape"
    done = 0
    for first in _ESCAPE.finditer(text):
        if first.start() < done:
            continue
        lo = text.rfind("\n", 0, first.start()) + 1
        hi = text.find("\n", first.start())
        hi = done = len(text) if hi < 0 else hi
        parts: list[str] = []
        starts, ends = array("q"), array("q")
        at, changed = lo, False

        def put(piece: str, a: int, b: int) -> None:
            """piece stands for the characters from a to b."""
            parts.append(piece)
            starts.extend([layer.start(a)] * len(piece))
            ends.extend([layer.end(b - 1)] * len(piece))

        def plain(upto: int) -> None:
            parts.append(text[at:upto])
            starts.extend(map(layer.start, range(at, upto)))
            ends.extend(map(layer.end, range(at, upto)))

        for m in _ESCAPE.finditer(text, lo, hi):
            e = m[0]
            if e[0] == "%":  # each character of a run has its own escapes
                plain(m.start())
                k = m.start()
                for c, n in _characters(bytes.fromhex(e.replace("%", ""))):
                    put(c, k, k + 3 * n)
                    k += 3 * n
            elif (got := _unescape(e)) is not None:
                plain(m.start())
                put(got, m.start(), m.end())
            else:
                continue
            at, changed = m.end(), True
        if changed:
            plain(hi)
            if isinstance(layer.starts, int):
                yield Layer("".join(parts), layer.starts, layer.ends, path)
            else:
                yield Layer("".join(parts), starts, ends, path)


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Content of gzip members (or zlib data) one after the other; ends where the data are damaged."""
    z, data = zlib.decompressobj(wbits=47), b""
    try:
        for chunk in chunks:
            data += chunk
            while data:
                part = z.decompress(data, _WINDOW)
                data = z.unconsumed_tail
                if z.eof:
                    data = z.unused_data
                    at = data.find(_GZIP)
                    data = data[at:] if at >= 0 else b""
                    z = zlib.decompressobj(wbits=47)
                if part:
                    yield part
                elif not data:
                    break
    except zlib.error:
        return


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The chunks in windows, each beginning with the end of the one before: all of a run that may go on, at least _OVERLAP."""
    tail = b""
    for chunk in chunks:
        tail += chunk
        yield tail
        run = re.search(rb"[A-Za-z0-9+/_=%\\\r\n \t-]*\Z", tail[-_LONGEST:])
        tail = tail[-min(len(tail), max(_OVERLAP, len(run[0]))) :]


def _of_stream(chunks: Iterator[bytes], lo: int, hi: int, path: str) -> Iterator[Layer]:
    """Layers of inflated data, all of which came from one stretch of the original; data that are compressed again are inflated as they come."""
    first = next(chunks, b"")
    while first and len(first) < 3 and (more := next(chunks, b"")):
        first += more
    whole = chain([first], chunks)
    if _ZLIB.match(first):
        yield from _of_stream(_inflated(whole), lo, hi, f"{path}/inflate")
        return
    for window in _windows(whole):
        for s, _, _ in _texts(window):
            yield Layer(s, lo, hi, path)
        for m in _ZLIB.finditer(window):
            yield from _of_stream(_inflated(iter([window[m.start() :]])), lo, hi, f"{path}/inflate")


def _texts(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, bytes a unit: 1 for UTF-8, 2 for UTF-16, first byte) of each reading of the bytes; any other byte becomes a character of its own."""
    yield raw.decode(errors="surrogateescape"), 1, 0
    for odd in (0, 1):
        pairs = raw[odd : len(raw) - (len(raw) - odd) % 2]
        if len(pairs) >= 12 and pairs[1::2].count(0) * 4 >= len(pairs):
            yield pairs.decode("utf-16-le", "replace"), 2, odd


def _promising(s: str) -> bool:
    return bool(scan(s) or _BASE64.search(s) or _ESCAPE.search(s))


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    yield from _lines(layer)
    text = layer.text
    if "%" in text or "\\" in text:
        for m in _TOKEN.finditer(text):  # escaped bytes of compressed data
            raw = _BYTE.sub(lambda b: bytes([int(b[1] or b[2] or b[3], 16)]), m[0].encode(errors="replace"))
            for z in _ZLIB.finditer(raw):
                yield from _of_stream(_inflated(iter([raw[z.start() :]])), layer.start(m.start()), layer.end(m.end() - 1), f"{layer.path}/escape/inflate")
    for m in _BASE64.finditer(text):
        run = m[0]
        places = range(m.start(), m.end()) if "\n" not in run else [m.start() + i for i, c in enumerate(run) if c not in "\r\n \t"]
        letters = run.translate(_STANDARD)
        for skip in range(4):  # the encoding may begin anywhere in the run
            body = letters[skip:]
            if len(body) % 4 == 1:
                body = body[:-1]
            if len(body) < 12:
                continue
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            for z in _ZLIB.finditer(raw):
                yield from _of_stream(_inflated(iter([raw[z.start() :]])), layer.start(places[skip + z.start() * 4 // 3]), layer.end(places[-1]), f"{layer.path}/base64/inflate")
            for s, unit, byte in _texts(raw):
                if not _promising(s):
                    continue
                if isinstance(layer.starts, int):
                    yield Layer(s, layer.starts, layer.ends, f"{layer.path}/base64")
                    continue
                starts, ends, at = array("q"), array("q"), byte
                for c in s:
                    n = 2 * (1 + (ord(c) > 0xFFFF)) if unit == 2 else 1 if 0xDC80 <= ord(c) <= 0xDCFF else len(c.encode())
                    starts.append(layer.start(places[skip + at * 8 // 6]))
                    ends.append(layer.end(places[skip + min((8 * (at + n) - 1) // 6, len(body) - 1)]))
                    at += n
                yield Layer(s, starts, ends, f"{layer.path}/base64")


def secrets_in(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, path) of all secrets, sorted by start, kind and end; path is empty for those of the text itself."""
    found: dict[tuple[int, int, int], str] = {k: "" for k in scan(text)}
    seen: set[tuple] = set()
    todo = [_unwrapped(Layer(text, None, None, ""))]
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        key = layer.identity()
        if key in seen:
            continue
        seen.add(key)
        for kind, a, b in scan(layer.text):
            found.setdefault((kind, layer.start(a), layer.end(b - 1)), layer.path)
        todo.append(_unwrapped(layer))
    return sorted(((k, a, b, p) for (k, a, b), p in found.items()), key=lambda x: (x[1], x[0], x[2]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())]))
    for batch in batches:
        rows = [[{"kind": KINDS[k], "start": a, "end": b, "path": p} for k, a, b, p in secrets_in(t)] if t else [] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "secrets"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and secrets (kind, start, end, path; path is empty for secrets of the text itself) of each row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_found, f"doc_id long, secrets {_SPANS}")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["path"] == "")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
