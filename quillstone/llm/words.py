"""Words of whole texts as 64-bit hashes, vectorised over Arrow string buffers.

A word's hash is a sum of random byte values times powers of an odd base modulo 2**64, mixed once more; two different
words share one with a chance near 2**-64 a pair. Long texts are cut into pieces only between words, so memory is
bounded by the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}

#: Byte tables: 0 separates words, anything else is the byte as compared. A-Z are lower-cased.
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
SPACED = _lower.copy()  # words [^\x20\x09-\x0D]+
SPACED[0] = 0xFF  # a byte that UTF-8 doesn't use, as byte 0 is part of words here
SPACED[[0x20, 9, 10, 11, 12, 13]] = 0
LETTERED = np.where((_lower >= 0x80) | ((_lower >= 48) & (_lower <= 57)) | ((_lower >= 97) & (_lower <= 122)), _lower, 0).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("up", _BASE), ("down", inverse)):
            out = np.ones(max(n, _PIECE), dtype=np.uint64)
            out[1:] = U(b)
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of each row and the end); null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def hash_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start byte, end byte) of every word, in order."""
    n = len(data)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pos = 0
    while pos < n:
        hi = min(n, pos + _PIECE)
        mapped = table[data[pos:hi]]
        if hi < n:
            gaps = np.flatnonzero(mapped == 0)
            if len(gaps):
                hi = pos + int(gaps[-1]) + 1
                mapped = mapped[: hi - pos]
            else:  # one word fills the piece: take all of it
                while hi < n and table[data[hi]]:
                    step = table[data[hi : hi + _PIECE]]
                    gap = np.flatnonzero(step == 0)
                    hi += int(gap[0]) if len(gap) else len(step)
                    if len(gap):
                        break
                mapped = table[data[pos:hi]]
        parts.append(_piece(mapped, pos, offsets))
        pos = hi
    if not parts:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e
    h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    row = np.searchsorted(offsets, s, side="right") - 1
    return h, row, s, e


def _piece(mapped: np.ndarray, pos: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(mapped)
    word = mapped != 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    cut = offsets[np.searchsorted(offsets, pos + 1) : np.searchsorted(offsets, pos + n)] - pos  # rows that begin inside
    if len(cut):
        start[cut] = word[cut]
        end[cut - 1] = word[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _power(n)
    total = np.cumsum(_BYTE[mapped] * up[:n])
    before = np.where(s > 0, total[s - 1], U(0))
    h = mix((total[e - 1] - before) * down[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return h, s + pos, e + pos


def hash_word(word: bytes, table: np.ndarray = SPACED) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(hash_words(data, np.array([0, len(data)]), table)[0][0])


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word's index) of every run of `size` words inside a row; a row of fewer words, but not none, gives one of all it has."""
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    if not len(h):
        return h, row, row
    full = len(h) - size + 1
    parts_h, parts_i = [], []
    if full > 0:
        at = np.flatnonzero(row[: full] == row[size - 1 :])
        acc = np.zeros(len(at), np.uint64)
        for j in range(size):
            acc = acc * U(_BASE) + h[at + j]
        parts_h.append(mix(acc))
        parts_i.append(at)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        acc = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            live = count[short] > j
            acc[live] = acc[live] * U(_BASE) + h[first[short[live]] + j]
        parts_h.append(mix(acc + count[short].astype(np.uint64)))
        parts_i.append(first[short])
    sh, at = np.concatenate(parts_h), np.concatenate(parts_i)
    order = np.argsort(at, kind="stable")
    sh, at = sh[order], at[order]
    return sh, row[at], at
