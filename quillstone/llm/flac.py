"""FLAC: an encoder and a decoder of 8-bit mono streams, vectorised over frames.

A frame holds up to BLOCK samples. The encoder predicts each frame by the best of fixed orders 0 to 2 and a quantised
linear predictor of order 2, and codes the residuals by Rice partitions. Streams hold STREAMINFO with the MD5 of the
samples, and a SEEKTABLE with each frame's first sample and offset, so blocks of samples can be read alone.

The decoder reads all frames of 8-bit mono streams: constant, verbatim, fixed and linear subframes up to order 32, any
partition order, 4- and 5-bit Rice parameters, escaped partitions and wasted bits. Where the seek table doesn't list
every frame, frames are found by their sync codes, numbers and checksums. It checks each header's CRC-8, each frame's
CRC-16 and the stream's MD5. Rice codes follow one another, so frames are decoded side by side: step i reads the i-th
residual of every frame of a piece. Frames with escapes, wasted bits or 5-bit parameters are read one at a time.

The query writes the streams as tables, decodes them to tables of PCM blocks with their sample offsets, and derives its
columns from those blocks. Streams of text are about as long as the text, so it does so in ROUNDS rounds over all rows.

Edge cases: an empty payload is a stream without frames; damaged or foreign streams fail with FlacError; null payloads
count as empty; repeated rows are coded each; a very long payload is coded and decoded by pieces of some thousand
frames at most, so only its bytes are held whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import row_keys, scratch, settle, table
from quillstone.llm.words import row_blocks

BLOCK = 4096
RATE = 8000
ENCODED_TOGETHER, DECODED_TOGETHER, _HASHED = 1 << 17, 1 << 22, 1 << 20  # bytes: arrays that fit a cache; as many frames side by side as memory allows
_ORDER, _PRECISION, _SHIFT = 2, 10, 8
_MOST_ZEROS = 40
ROUNDS = 4
_ONES = (1 << 13) + 16  # bytes: as many bits as a frame can have samples, and some
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]  # the format's fixed predictors
_U = np.uint64


class FlacError(ValueError):
    pass


def _crc_bytes(poly: int, bits: int) -> list[int]:
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_bytes(0x07, 8), _crc_bytes(0x8005, 16)
_STRETCH = 64
_held: list[np.ndarray] = []


def _crc16_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-16 is linear: of a byte by its distance from a stretch's end; and of a stretch's high and low byte by 0, 1, 2, ... stretches that follow."""
    one = np.array(_CRC16, np.uint16)
    step = lambda c: (c << np.uint16(8)) ^ one[c >> np.uint16(8)]
    rows = [one]
    for _ in range(_STRETCH - 1):
        rows.append(step(rows[-1]))
    pair = np.stack([np.arange(256, dtype=np.uint16) << np.uint16(8), np.arange(256, dtype=np.uint16)])
    after = [pair]
    for _ in range(2 * BLOCK // _STRETCH):
        for _ in range(_STRETCH):
            pair = step(pair)
        after.append(pair)
    return np.stack(rows[::-1]), np.stack(after)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each of the stretches of data. Zeros in front don't change it, so each is filled up to whole stretches of 64 bytes."""
    if not _held:
        _held.extend(_crc16_tables())
    by_byte, by_stretch = _held
    chunks = -(-sizes // _STRETCH)
    if int(chunks.max()) > len(by_stretch):
        raise FlacError("a frame is too long")
    ends = np.cumsum(chunks) * _STRETCH
    padded = np.zeros(int(ends[-1]), np.uint8)
    shift = np.repeat(ends - starts - sizes, sizes)
    at = np.arange(len(shift)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    padded[at + shift] = data[at]
    crc = np.bitwise_xor.reduce(by_byte[np.arange(_STRETCH), padded.reshape(-1, _STRETCH)], axis=1)
    left = np.repeat(np.cumsum(chunks), chunks) - 1 - np.arange(len(crc))
    crc = by_stretch[left, 0, crc >> np.uint16(8)] ^ by_stretch[left, 1, crc & np.uint16(0xFF)]
    return np.bitwise_xor.reduceat(crc, np.cumsum(chunks) - chunks)


def _coded_number(n: int) -> bytes:
    """A frame number, coded as UTF-8 codes characters, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        k = len(tail)
        if n < 1 << max(0, 6 - k):
            return bytes([(0xFF << (7 - k) & 0xFF) | n, *reversed(tail)])


def _frame_header(number: int, samples: int) -> bytes:
    head = b"\xff\xf8" + bytes([(0b1100 if samples == BLOCK else 0b0111) << 4 | 0b0100, 0b0000_001_0]) + _coded_number(number)
    if samples != BLOCK:
        head += (samples - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _linear(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of each frame's linear predictor, and the residuals."""
    lagged = [x]
    for lag in range(1, _ORDER + 1):
        y = np.zeros_like(x)
        y[lag:] = x[:-lag]
        for j in range(lag):
            y[np.minimum(first + j, len(x) - 1)] = 0
        lagged.append(y)
    r = np.stack([np.add.reduceat(x * y, first) for y in lagged], axis=1).astype(np.float64)
    m = np.abs(np.arange(_ORDER)[:, None] - np.arange(_ORDER)[None, :])
    a = r[:, m] + (1e-3 * r[:, :1, None] + 1) * np.eye(_ORDER)
    top = (1 << (_PRECISION - 1)) - 1
    coefs = np.clip(np.round(np.linalg.solve(a, r[:, 1:, None])[:, :, 0] * (1 << _SHIFT)), -top, top).astype(np.int32)
    guess = np.repeat(coefs[:, 0], size) * lagged[1]
    for j in range(1, _ORDER):
        guess += np.repeat(coefs[:, j], size) * lagged[j + 1]
    return coefs, x - (guess >> _SHIFT)


def encode(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A FLAC stream for the bytes of each row; a byte's sample is its value less 128."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    per_row = -(-sizes // BLOCK)
    frame_row = np.repeat(np.arange(rows), per_row)
    number = np.arange(len(frame_row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    first = offsets[frame_row] + number * BLOCK - offsets[0]
    size = np.minimum(BLOCK, offsets[frame_row + 1] - offsets[0] - first)
    pieces, lengths = [], [np.zeros(0, np.int64)]
    for lo, hi in row_blocks(np.append(first, len(data)), ENCODED_TOGETHER):
        end = int(first[hi - 1] + size[hi - 1])
        raw = data[int(first[lo]) : end].astype(np.int32) - 128
        body, begin = _encode_frames(raw, first[lo:hi] - first[lo], size[lo:hi], number[lo:hi])
        pieces.append(body)
        lengths.append(np.diff(begin))
    body, begin = b"".join(pieces), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    out, f = [], 0
    for r in range(rows):
        n, k = int(sizes[r]), int(per_row[r])
        body_at = begin[f : f + k + 1]
        own = np.diff(body_at)
        info = min(BLOCK, max(16, n)).to_bytes(2, "big") * 2
        info += int(own.min() if k else 0).to_bytes(3, "big") + int(own.max(initial=0)).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + _md5(data[int(offsets[r] - offsets[0]) : int(offsets[r + 1] - offsets[0])])
        seek = np.zeros(k, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        seek["sample"], seek["offset"], seek["count"] = number[f : f + k] * BLOCK, body_at[:-1] - body_at[0], size[f : f + k]
        points = seek.tobytes()
        blocks = b"\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points
        out.append(b"fLaC" + blocks + body[int(body_at[0]) : int(body_at[-1])])
        f += k
    return out


def _md5(payload: np.ndarray) -> bytes:
    """MD5 of the signed samples of a payload."""
    found = hashlib.md5()
    for at in range(0, len(payload), _HASHED):
        found.update((payload[at : at + _HASHED] ^ np.uint8(0x80)).tobytes())
    return found.digest()


def _encode_frames(x: np.ndarray, first: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All frames' bytes, and each frame's offset and the end."""
    n_frames = len(first)
    d1 = np.diff(x, prepend=x[:1])
    d2 = np.diff(d1, prepend=d1[:1])
    coefs, linear = _linear(x, first, size)
    tried = [(0, x), (1, d1), (2, d2), (_ORDER, linear)]
    cost = np.empty((4, n_frames), np.int64)
    for b, (o, e) in enumerate(tried):
        for j in range(o):  # warm-up samples cost a byte, about as a residual of 128 does
            e[first[size > j] + j] = 128
        cost[b] = np.add.reduceat(np.abs(e), first)
        cost[b, size <= o] = np.iinfo(np.int64).max
    best = np.argmin(cost, axis=0)
    order = np.array([o for o, _ in tried])[best]
    chosen = linear
    for b in np.unique(best[best < 3]).tolist():
        here = np.repeat(best == b, size)
        chosen[here] = tried[b][1][here]
    warm = np.concatenate([first[order > j] + j for j in range(_ORDER)])
    warm_frame = np.concatenate([np.flatnonzero(order > j) for j in range(_ORDER)])
    warm_place = warm - first[warm_frame]
    u = (chosen << 1) ^ (chosen >> 31)
    u[warm] = 0
    # Partitions: as many as leave 64 samples or more in each, 16 at most.
    parts_log = np.zeros(n_frames, np.int64)
    for p in range(1, 5):
        parts_log[(size % (1 << p) == 0) & (size >> p >= 64)] = p
    parts = 1 << parts_log
    n_parts = int(parts.sum())
    part_frame = np.repeat(np.arange(n_frames), parts)
    nth = np.arange(n_parts) - (np.cumsum(parts) - parts)[part_frame]
    span = (size >> parts_log)[part_frame]
    part_start = first[part_frame] + nth * span
    mean = np.add.reduceat(u, part_start, dtype=np.int64) / span
    most = np.maximum.reduceat(u, part_start)
    k = np.floor(np.log2(np.maximum(mean * 0.7, 1))).astype(np.int64)
    k = np.minimum(np.maximum(k, np.ceil(np.log2(np.maximum(most, 1) / _MOST_ZEROS)).astype(np.int64)), 14)
    ks = np.repeat(k.astype(np.int32), span)
    q = u >> ks
    length = q + 1
    length += ks
    length[warm] = 0
    # Where everything stands, in bits.
    heads = [_frame_header(int(n), int(s)) for n, s in zip(number, size, strict=True)]
    head_bytes = np.array([len(h) for h in heads])
    is_linear = best == 3
    before = head_bytes * 8 + 8 + order * 8 + np.where(is_linear, 9 + _ORDER * _PRECISION, 0) + 6
    code_bits = np.add.reduceat(length, first, dtype=np.int64)
    frame_bytes = (before + 4 * parts + code_bits + 7) // 8 + 2
    begin = np.concatenate([[0], np.cumsum(frame_bytes)])
    run = np.cumsum(length, dtype=np.int64) - length
    part_base = (begin[:-1] * 8 + before - run[first])[part_frame] + 4 * nth
    value = u + ((1 - q) << ks)  # the one and the k bits after it
    value[warm] = 0
    fields = [(run + np.repeat(part_base + 4, span) + q, ks + 1, value), (part_base + run[part_start], np.full(n_parts, 4), k)]
    all_heads = np.frombuffer(b"".join(heads), np.uint8).astype(np.int64)
    head_frame = np.repeat(np.arange(n_frames), head_bytes)
    head_at = np.arange(len(all_heads)) - (np.cumsum(head_bytes) - head_bytes)[head_frame]
    fields.append(((begin[head_frame] + head_at) * 8, np.full(len(all_heads), 8), all_heads))
    sub = np.where(is_linear, 0b100000 | (_ORDER - 1), 0b001000 | order)
    body = begin[:-1] * 8 + head_bytes * 8
    fields.append((body, np.full(n_frames, 8), sub << 1))
    fields.append((body[warm_frame] + 8 + warm_place * 8, np.full(len(warm), 8), x[warm] & 0xFF))
    lin = np.flatnonzero(is_linear)
    if len(lin):
        here = body[lin] + 8 + 8 * _ORDER
        fields.append((here, np.full(len(lin), 9), np.full(len(lin), (_PRECISION - 1) << 5 | _SHIFT)))
        for j in range(_ORDER):
            fields.append((here + 9 + j * _PRECISION, np.full(len(lin), _PRECISION), coefs[lin, j] & ((1 << _PRECISION) - 1)))
    fields.append((begin[:-1] * 8 + before - 6, np.full(n_frames, 6), parts_log))
    out = _place_bits(fields, int(begin[-1]))
    crc = crc16(out, begin[:-1], frame_bytes - 2)
    out[begin[1:] - 2], out[begin[1:] - 1] = crc >> np.uint16(8), crc & np.uint16(0xFF)
    return out.tobytes(), begin


def _place_bits(fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_bytes: int) -> np.ndarray:
    """Bytes with each field (bit offset, length up to 16, value) in place; fields don't overlap, so sums are unions."""
    words = n_bytes // 4 + 2
    total = np.zeros(words)
    for at, length, value in fields:
        w = at >> 5
        v = value.astype(np.uint64) << (64 - (at & 31) - length).astype(np.uint64)
        total += np.bincount(w, weights=(v >> _U(32)).astype(np.float64), minlength=words)
        total += np.bincount(w + 1, weights=(v & _U(0xFFFFFFFF)).astype(np.float64), minlength=words)
    return np.frombuffer(total.astype(np.uint32).astype(">u4").tobytes(), np.uint8)[:n_bytes].copy()


class _Stream:
    """A stream's samples in all, MD5, and the offsets of its frames within `raw`."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"fLaC":
            raise FlacError("no FLAC stream")
        at, last, points = 4, False, b""
        self.total = -1
        while not last:
            if at + 4 > len(raw):
                raise FlacError("metadata are cut short")
            kind, n = raw[at], int.from_bytes(raw[at + 1 : at + 4], "big")
            last, body = bool(kind & 0x80), raw[at + 4 : at + 4 + n]
            at += 4 + n
            if kind & 0x7F == 0:
                packed = int.from_bytes(body[10:18], "big")
                if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                    raise FlacError("only 8-bit mono streams are read")
                self.total, self.md5 = packed & ((1 << 36) - 1), body[18:34]
            elif kind & 0x7F == 3:
                points = body
        if self.total < 0:
            raise FlacError("no STREAMINFO")
        seek = np.frombuffer(points[: len(points) // 18 * 18], [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        seek = seek[seek["sample"] != (1 << 64) - 1]
        self.samples, counts = seek["sample"].astype(np.int64), seek["count"].astype(np.int64)
        self.starts = at + seek["offset"].astype(np.int64)
        if not (int(counts.sum()) == self.total and (self.samples == np.cumsum(counts) - counts).all()):
            self._find_frames(raw, at)
        self.ends = np.append(self.starts[1:], len(raw))[: len(self.starts)]

    def _find_frames(self, raw: bytes, at: int) -> None:
        """Frames by their sync codes: the next one has the next number and ends a stretch whose CRC-16 is right."""
        starts, samples, sample = [], [], 0
        while sample < self.total:
            n, _, number = _header(raw, at)
            starts.append(at)
            samples.append(sample)
            sample += n
            if sample >= self.total:
                break
            sync, wanted, end = raw[at : at + 2], number + (n if raw[at + 1] & 1 else 1), at
            while True:
                end = raw.find(sync, end + 2)
                if end < 0:
                    raise FlacError("a frame is missing")
                try:
                    follows = _header(raw, end)[2] == wanted
                except (FlacError, IndexError):
                    continue
                if follows and not _crc16_of(raw[at:end]):
                    break
            at = end
        self.starts, self.samples = np.array(starts, np.int64), np.array(samples, np.int64)


def _crc16_of(raw: bytes) -> int:
    c = 0
    for b in raw:
        c = (c << 8 & 0xFF00) ^ _CRC16[c >> 8 ^ b]
    return c


def _header(raw: bytes, at: int) -> tuple[int, int, int]:
    """(samples, bytes, coded number) of the frame header at `at`, its CRC-8 checked."""
    if raw[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9") or at + 6 > len(raw):
        raise FlacError("no frame where one should be")
    code, rate = raw[at + 2] >> 4, raw[at + 2] & 15
    lead = raw[at + 4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    p = at + 5 + more
    number = lead & (0x7F if lead < 0x80 else 0x3F >> more)
    for b in raw[at + 5 : p]:
        number = number << 6 | b & 0x3F
    if code == 6:
        n, p = raw[p] + 1, p + 1
    elif code == 7:
        n, p = int.from_bytes(raw[p : p + 2], "big") + 1, p + 2
    else:
        n = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(raw) or crc8(raw[at:p]) != raw[p]:
        raise FlacError("a frame header fails its CRC-8")
    return n, p + 1 - at, number


def _pcm_of(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples plus 128 of all streams as bytes, samples of each frame, frames of each stream). All checksums are verified."""
    infos = [_Stream(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    raw = b"".join(streams) if len(streams) > 1 else streams[0] if streams else b""
    none = np.zeros(0, np.int64)
    starts = np.concatenate([none, *[s.starts + b for s, b in zip(infos, base, strict=False)]])
    ends = np.concatenate([none, *[s.ends + b for s, b in zip(infos, base, strict=False)]])
    pcm, counts = [np.zeros(0, np.uint8)], [none]
    for x, n in _decode_pieces(raw, starts, ends):
        pcm.append(x)
        counts.append(n)
    whole, sizes = np.concatenate(pcm), np.concatenate(counts)
    frames = np.array([len(s.starts) for s in infos], np.int64)
    f, at = 0, 0
    for s, k in zip(infos, frames.tolist(), strict=True):
        n = int(sizes[f : f + k].sum())
        if n != s.total or _md5(whole[at : at + n]) != s.md5:
            raise FlacError("a stream fails its MD5")
        f, at = f + k, at + n
    return whole, sizes, frames


def _decode_pieces(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, samples of each frame) of pieces of frames, DECODED_TOGETHER bytes of media or so at a time."""
    for lo, hi in row_blocks(np.concatenate([[0], np.cumsum(ends - starts)]), DECODED_TOGETHER):
        a = int(starts[lo])
        x, counts = _decode_frames(raw[a : int(ends[hi - 1])], starts[lo:hi] - a, ends[lo:hi] - a)
        yield (x + 128).astype(np.uint8), counts


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream: its samples plus 128 as bytes. All checksums are verified."""
    pcm, sizes, frames = _pcm_of(streams)
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(frames)])]
    return [pcm[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decode_blocks(stream: bytes, first: int = 0, until: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(sample offset, PCM bytes) of the frames that hold samples in [first, until), found through the seek table."""
    s = _Stream(stream)
    until = s.total if until is None else until
    after = np.append(s.samples[1:], s.total)[: len(s.samples)]
    some = np.flatnonzero((s.samples < until) & (after > first))
    offsets = iter(s.samples[some].tolist())
    for x, counts in _decode_pieces(stream, s.starts[some], s.ends[some]):
        at = 0
        for n in counts.tolist():
            yield next(offsets), x[at : at + n].tobytes()
            at += n


def _decode_frames(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all frames one after another, and each frame's count."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    if (ends - starts < 8).any() or crc16(data, starts, ends - starts).any():
        raise FlacError("a frame fails its CRC-16")
    n_frames = len(starts)
    counts, order, bit, parts, kind = (np.zeros(n_frames, np.int64) for _ in range(5))
    shift = np.zeros(n_frames, np.int64)
    coefs: list[list[int]] = [[]] * n_frames
    warm: list[list[int]] = [[]] * n_frames
    plain: dict[int, np.ndarray] = {}
    for f, at in enumerate(starts.tolist()):
        n, head, _ = _header(raw, at)
        counts[f] = n
        p = at + head
        sub = raw[p] >> 1
        if raw[p] & 1:
            plain[f] = _frame_alone(raw, p, n)
            continue
        p += 1
        if sub == 0:
            plain[f] = np.full(n, int.from_bytes(raw[p : p + 1], "big", signed=True), np.int64)
            continue
        if sub == 1:
            plain[f] = np.frombuffer(raw[p : p + n], np.int8).astype(np.int64)
            continue
        if not (8 <= sub <= 12 or sub >= 32):
            raise FlacError("a subframe of no known kind")
        kind[f] = 1 if sub < 32 else 2
        o = order[f] = sub & 7 if sub < 32 else (sub & 31) + 1
        warm[f] = np.frombuffer(raw[p : p + o], np.int8).tolist()
        p += int(o)
        skip = 0
        if sub >= 32:
            width = 9 + 15 * int(o)
            bits = int.from_bytes(raw[p : p + width // 8 + 2], "big")
            whole = 8 * (width // 8 + 2)
            precision = (bits >> (whole - 4)) + 1
            shift[f] = bits >> (whole - 9) & 31
            got = [bits >> (whole - 9 - precision * (j + 1)) & ((1 << precision) - 1) for j in range(int(o))]
            coefs[f] = [c - (1 << precision) if c >> (precision - 1) else c for c in got]
            skip = 9 + precision * int(o)
        p, skip = p + skip // 8, skip % 8
        word = int.from_bytes(raw[p : p + 2], "big") << skip & 0xFFFF
        if word >> 14:
            kind[f], order[f], warm[f], plain[f] = 0, 0, [], _frame_alone(raw, at + head, n)
            continue
        parts[f] = word >> 10 & 15
        bit[f] = p * 8 + skip + 6
    residual, escaped = _rice(data, bit, counts, order, parts, kind)
    for f in escaped:
        at = int(starts[f])
        kind[f], order[f], warm[f], plain[f] = 0, 0, [], _frame_alone(raw, at + _header(raw, at)[1], int(counts[f]))
    return _restore(residual, counts, order, kind, warm, coefs, shift, plain), counts


def _rice(data: np.ndarray, bit: np.ndarray, counts: np.ndarray, order: np.ndarray, parts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Residuals of all frames at their samples' places, one residual of every frame a step; and the frames that have escaped partitions, which are not read."""
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int64)
    # A frame with an escape goes on in the ones behind the data, a bit a residual.
    padded = np.concatenate([data, np.zeros(8, np.uint8), np.full(_ONES, 255, np.uint8)]).astype(np.uint64)
    aside, escaped = (len(data) + 8) * 8, []
    n = len(padded) - 8
    window = np.zeros(n, np.uint64)
    for j in range(8):
        window |= padded[j : j + n] << _U(56 - 8 * j)
    todo = counts - order
    todo[kind == 0] = 0
    lanes = np.argsort(-todo, kind="stable")
    lanes = lanes[todo[lanes] > 0]
    todo, pos = todo[lanes], bit[lanes].copy()
    span, place = (counts >> parts)[lanes], (first + order)[lanes]
    next_part = np.zeros(len(lanes), np.int64)
    upto = span - order[lanes]
    k = np.zeros(len(lanes), np.int64)
    rest = np.full(len(lanes), 63, np.uint64)
    active = np.searchsorted(-todo, -np.arange(int(todo.max(initial=0))), side="left")  # lanes that still have a residual i
    for i, a in enumerate(active.tolist()):
        new = np.flatnonzero(next_part[:a] == i)
        while len(new):
            p = pos[new]
            k[new] = ((window[p >> 3] << (p & 7).view(np.uint64)) >> _U(60)).astype(np.int64)
            off = new[k[new] == 15]
            k[off] = 0
            rest[new] = (63 - k[new]).view(np.uint64)
            pos[new] = p + 4
            next_part[new] = upto[new]
            upto[new] += span[new]
            if len(off):
                escaped.extend(lanes[off].tolist())
                pos[off], next_part[off] = aside, -1
            new = new[next_part[new] == i]
        p, kk = pos[:a], k[:a]
        w = window[p >> 3] << (p & 7).view(np.uint64)
        zeros = 1075 - ((w >> _U(11)).astype(np.float64).view(np.int64) >> 52)  # the exponent tells the highest bit
        low = ((w << (zeros + 1).view(np.uint64)) >> _U(1)) >> rest[:a]
        if int(zeros.max()) > 40:  # a long run of zeros, or one that the window cuts
            for lane in np.flatnonzero(zeros > 40).tolist():
                zeros[lane] = _zeros_from(data, int(p[lane]))
                b = int(p[lane] + zeros[lane] + 1)
                low[lane] = (int(window[b >> 3]) << (b & 7) & (1 << 64) - 1) >> 1 >> int(rest[lane])
        out[place[:a] + i] = (zeros << kk) | low.view(np.int64)
        p += zeros
        p += kk
        p += 1
    return (out >> 1) ^ -(out & 1), escaped


class _Bits:
    """Reads a frame's bits one field at a time."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at = raw, at * 8

    def take(self, n: int, signed: bool = False) -> int:
        end = self.at + n
        held = self.raw[self.at >> 3 : (end + 7) >> 3]
        if len(held) * 8 < (self.at & 7) + n:
            raise FlacError("a frame is cut short")
        v = int.from_bytes(held, "big") >> (-end & 7) & ((1 << n) - 1)
        self.at = end
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _frame_alone(raw: bytes, at: int, n: int) -> np.ndarray:
    """The samples of one subframe of any kind, which starts at byte `at`."""
    b = _Bits(raw, at)
    kind, wasted = b.take(8), 0
    if kind & 1:
        wasted = b.unary() + 1
    kind, width = kind >> 1, 8 - wasted
    if width < 1:
        raise FlacError("a subframe without bits")
    if kind == 0:
        x = [b.take(width, signed=True)] * n
    elif kind == 1:
        x = [b.take(width, signed=True) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind & 7 if kind < 32 else (kind & 31) + 1
        x = [b.take(width, signed=True) for _ in range(order)]
        shift, coefs = 0, _FIXED[order] if kind < 32 else []
        if kind >= 32:
            precision, shift = b.take(4) + 1, b.take(5)
            coefs = [b.take(precision, signed=True) for _ in range(order)]
        for e in _residuals_alone(b, n, order):
            x.append(e + (sum(c * x[-1 - j] for j, c in enumerate(coefs)) >> shift))
    else:
        raise FlacError("a subframe of no known kind")
    return np.array(x, np.int64) << wasted


def _residuals_alone(b: _Bits, n: int, order: int) -> Iterator[int]:
    method = b.take(2)
    if method > 1:
        raise FlacError("residuals of no known coding")
    width, parts = 4 + method, 1 << b.take(4)
    for part in range(parts):
        k = b.take(width)
        raw = b.take(5) if k == (1 << width) - 1 else None
        for _ in range(n // parts - (0 if part else order)):
            if raw is None:
                u = b.unary() << k | b.take(k)
                yield u >> 1 ^ -(u & 1)
            else:
                yield b.take(raw, signed=True)


def _zeros_from(data: np.ndarray, bit: int) -> int:
    n, at = 0, bit >> 3
    value, left = int(data[at]) & (0xFF >> (bit & 7)), 8 - (bit & 7)
    while not value:
        n, at = n + left, at + 1
        if at >= len(data):
            raise FlacError("a residual is cut short")
        value, left = int(data[at]), 8
    return n + left - value.bit_length()


def _restore(res: np.ndarray, counts: np.ndarray, order: np.ndarray, kind: np.ndarray, warm: list, coefs: list, shift: np.ndarray, plain: dict) -> np.ndarray:
    """Samples from residuals: fixed orders by repeated sums, linear predictors step by step over all their frames."""
    first = np.cumsum(counts) - counts
    for f, w in enumerate(warm):
        res[first[f] : first[f] + len(w)] = w
    for f, x in plain.items():
        res[first[f] : first[f] + len(x)] = x
    for o in range(1, 5):
        for f in np.flatnonzero((kind == 1) & (order == o)).tolist():
            a, b = int(first[f]), int(first[f] + counts[f])
            x = res[a:b]
            heads = [x[:o]]
            for _ in range(1, o):
                heads.append(np.diff(heads[-1]))
            x = x[o:]
            for h in reversed(heads):
                x = np.cumsum(np.concatenate([h[-1:], x]))[1:]
            res[a + o : b] = x
    for o in np.unique(order[kind == 2]).tolist():
        frames = np.flatnonzero((kind == 2) & (order == o))
        frames = frames[np.argsort(-counts[frames], kind="stable")]
        c = np.array([coefs[f] for f in frames], np.int64)
        at, n, s = first[frames], counts[frames], shift[frames]
        held = [res[at + o - 1 - j].copy() for j in range(o)]
        for i in range(o, int(n[0])):
            a = int(np.searchsorted(-n, -i, side="left"))
            guess = c[:a, 0] * held[0][:a]
            for j in range(1, o):
                guess += c[:a, j] * held[j][:a]
            x = res[at[:a] + i] + (guess >> s[:a])
            res[at[:a] + i] = x
            held = [x, *held[:-1]]
    return res


def payload(text: Column) -> Column:
    """A text's UTF-8 bytes, then zeros up to a positive multiple of 64."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    padded = F.greatest(F.lit(64), F.ceil(n / F.lit(64)).cast("int") * 64)
    return F.concat(raw, F.encode(F.repeat(F.lit("\x00"), padded - n), "UTF-8"))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    from quillstone.llm.words import string_buffers

    return string_buffers(pa.array([b or b"" for b in column.to_pylist()], pa.large_binary()) if column.null_count else column)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _buffers(batch.column(2))
        for lo, hi in row_blocks(offsets, ENCODED_TOGETHER):
            media = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_payloads(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of rows (doc_id, n_bytes, payload)."""
    return rows.select("doc_id", "n_bytes", "payload").mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


def feature_of(pcm: bytes | np.ndarray) -> str:
    """Blocks, sum of sizes of the samples, energy and sign changes, as whole numbers."""
    raw = np.frombuffer(pcm, np.uint8)
    size = energy = changes = 0
    for at in range(0, len(raw), _HASHED):
        x = raw[max(0, at - 1) : at + _HASHED].astype(np.int64) - 128
        changes += int(np.count_nonzero(np.diff(x >= 0)))
        x = x[1:] if at else x
        size, energy = size + int(np.abs(x).sum()), energy + int((x * x).sum())
    return f"{-(-len(raw) // BLOCK)}:{size}:{energy}:{changes}"


_BLOCKS = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(2)
        _, offsets = _buffers(media)
        for lo, hi in row_blocks(offsets, DECODED_TOGETHER):
            pcm, sizes, frames = _pcm_of([m.as_py() for m in media.slice(lo, hi - lo)])
            ends, rows = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(frames)])
            at = ends[:-1] - np.repeat(ends[rows[:-1]], frames)
            held = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(pcm)])
            blocks = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.StructArray.from_arrays([pa.array(at), held], fields=list(_BLOCKS.value_type)))
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), blocks], names=["doc_id", "n_bytes", "media", "blocks"])


def media_blocks(rows: DataFrame) -> DataFrame:
    """rows (doc_id, n_bytes, media) and blocks: the PCM of each frame with the offset of its first sample."""
    return rows.select("doc_id", "n_bytes", "media").mapInArrow(_decoded, "doc_id long, n_bytes long, media binary, blocks array<struct<sample_offset: long, pcm: binary>>")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = batch.column(batch.num_columns - 1)
        pcm = blocks.values.field("pcm")
        starts = np.frombuffer(pcm.buffers()[1], np.int32)[pcm.offset : pcm.offset + len(pcm) + 1] if len(pcm) else np.zeros(1, np.int32)
        data = np.frombuffer(pcm.buffers()[2], np.uint8) if len(pcm) and pcm.buffers()[2] else np.zeros(0, np.uint8)
        at = starts[blocks.offsets.to_numpy()].tolist()
        found = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        measures = [
            pa.array([len(x) for x in found], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
            pa.array([zlib.crc32(x[-64:]) for x in found], pa.int64()),
            pa.array([feature_of(x) for x in found], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *measures], names=[*batch.schema.names[:-1], "payload_bytes", "payload_sha256", "tail_crc32", "feature"])


def measure_blocks(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256 of rows that also have blocks; payload_bytes, payload_sha256, tail_crc32, feature of these."""
    return rows.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(
        _measured, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pcm = [b"".join(b["pcm"] for b in blocks) for blocks in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pcm, pa.binary()), pa.array([feature_of(p) for p in pcm], pa.string())], names=["doc_id", "n_bytes", "media", "payload", "feature"])


def decode_media(rows: DataFrame) -> DataFrame:
    """rows (doc_id, n_bytes, media) and payload, feature."""
    return media_blocks(rows).mapInArrow(_joined, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def pcm_blocks(rows: DataFrame) -> DataFrame:
    """doc_id, sample_offset, pcm: a row for each block of samples of rows (doc_id, media)."""
    return media_blocks(rows.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), "media")).select("doc_id", F.inline("blocks"))


def stored_blocks(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256, blocks of rows (doc_id, n_bytes, payload, _file, _row), as written tables.

    Every stream is written to the shared folder and read back from there. The rounds, which together take every row,
    bound how much of the streams lies on disk at once: a round's streams go when its blocks are written.
    """
    spark, done = rows.sparkSession, []
    for i in range(rounds):
        with scratch(spark) as keep:
            part = rows.where(F.pmod(F.xxhash64("_file", "_row"), F.lit(rounds)) == i)
            media = settle(encode_payloads(part), "flac")
            read = media_blocks(media).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "blocks")
            done.append(keep(settle(read, "pcm")))
    return reduce(DataFrame.unionByName, done)


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = row_keys(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), payload(F.col("text")).alias("payload"), "_file", "_row")
    return measure_blocks(stored_blocks(rows)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
