"""Splitting texts into words, vectorised over an Arrow batch.

All functions work on the UTF-8 bytes of many texts at once. Every word class used here is
a set of bytes below 0x80 plus "all bytes from 0x80", so byte work equals code point work.
Words are compared by 64-bit hashes (random table per byte value, polynomial in position,
mixed at the end); two different words collide with probability about 2**-52 or less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
_BLOCK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that are not ASCII white space (blank, tab to carriage return).
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: empty) and where each text starts and ends."""
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return buf, o - o[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows of at most ``limit`` bytes."""
    buf, offs = text_bytes(col)
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def split_words(buf: np.ndarray, offs: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text plus the total) of the runs of ``word_byte`` bytes."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    m = word_byte[buf]
    edge = offs[(offs > 0) & (offs < len(buf))]
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    before[edge] = False
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _BLOCK not in _POWERS:
        _POWERS[_BLOCK] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * _BLOCK, p, np.uint64)]), dtype=np.uint64) for p in (_P, _P_INV))
    if n <= 2 * _BLOCK:
        return _POWERS[_BLOCK]
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, p, np.uint64)]), dtype=np.uint64) for p in (_P, _P_INV))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal bytes, never 0."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        part = buf[lo : ends[j - 1]]
        pw, inv = _powers(len(part))
        run = np.empty(len(part) + 1, np.uint64)
        run[0] = 0
        np.cumsum(_TABLE[part] * pw[: len(part)], out=run[1:])
        s = starts[i:j] - lo
        out[i:j] = (run[ends[i:j] - lo] - run[s]) * inv[s]
        i = j
    out = mix(out)
    out[out == 0] = 1
    return out


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that begin at each word (shorter by n - 1 than ``h``)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:m].copy()
    for k in range(1, n):
        acc *= _P
        acc += h[k : k + m]
    return mix(acc + np.uint64(n))


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Which of the n-word windows over the concatenated words stay within one text."""
    total = int(first[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
