"""Vectorised word tokens and hashes over Arrow string columns.

Everything works on the UTF-8 bytes of whole texts, in chunks of documents, so
memory follows the largest document and not the Arrow batch.  Hashes come from
fixed seeds and are equal on every executor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
CHUNK_TEXTS = 512

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: Two scramblings of 64-bit values, fixed: shifts and multipliers.
_MIXERS = (
    (30, 0xBF58476D1CE4E5B9, 27, 0x94D049BB133111EB, 31),
    (33, 0xFF51AFD7ED558CCD, 29, 0xC4CEB9FE1A85EC53, 32),
)
#: Words longer than this are hashed one by one.
_LONG_WORD = 256

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII characters other than letters and digits, for comparisons that ignore punctuation
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The first 0 to 8 bytes of a little-endian lane.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def mix(h: np.ndarray, which: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values; the second is independent of the first."""
    a, p, b, q, c = _MIXERS[which]
    h = h ^ (h >> _U(a))
    h *= _U(p)
    h ^= h >> _U(b)
    h *= _U(q)
    h ^= h >> _U(c)
    return h


@dataclass
class Words:
    """The words of some consecutive documents.

    ``first[i]:first[i + 1]`` are the words of document ``i`` of the chunk;
    ``start``/``end`` are byte positions in ``data``.
    """

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; both hashes (0 and 1) together are one of 128 bits.

        A word's bytes pass eight at a time through a full scrambling, with its length, so
        words of one length of up to eight bytes never share a hash."""
        size = self.end - self.start
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = self.data
        lanes = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        seed = size.astype(_U) * _BASE
        h = mix(seed ^ (lanes[self.start] & _LANE[np.minimum(size, 8)]), which)
        more, done = np.flatnonzero((size > 8) & (size <= _LONG_WORD)), 8
        while len(more):
            left = size[more] - done
            h[more] = mix(h[more] ^ (lanes[self.start[more] + done] & _LANE[np.minimum(left, 8)]), which)
            more, done = more[left > 8], done + 8
        for i in np.flatnonzero(size > _LONG_WORD).tolist():
            word = self.data[self.start[i] : self.end[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([which])).digest(), "little")
        return h


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def tokenize(data: np.ndarray, off: np.ndarray, lo: int, hi: int, white: np.ndarray, lower: bool) -> Words:
    """Words of documents lo..hi-1: maximal runs of bytes that are not ``white``."""
    d = data[off[lo] : off[hi]]
    if lower:
        d = LOWER[d]
    at = off[lo : hi + 1] - off[lo]
    black = ~white[d]
    edge = np.zeros(len(d) + 1, bool)
    edge[at] = True  # documents touch each other without white space
    before = np.empty(len(d), bool)
    before[:1] = True
    np.logical_or(~black[:-1], edge[1:-1], out=before[1:])
    after = np.empty(len(d), bool)
    after[-1:] = True
    after[:-1] = before[1:]
    after[:-1] = ~black[1:] | edge[1:-1]
    start = np.flatnonzero(black & before)
    end = np.flatnonzero(black & after) + 1
    return Words(lo, hi, d, start, end, np.searchsorted(start, at))


def chunks(column: pa.Array, white: np.ndarray = WHITE, lower: bool = False) -> Iterator[Words]:
    """The words of a column, some whole documents at a time."""
    data, off = string_buffers(column)
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, lo + CHUNK_TEXTS)
        yield tokenize(data, off, lo, hi, white, lower)
        lo = hi


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of k consecutive values of ``h`` (those that cross documents too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, (salt * 2 + 1) * int(_BASE) % 2**64, _U)
    for i in range(k):
        out *= _BASE
        out += h[i : i + n]
        if i % 8 == 7:
            out ^= out >> _U(29)
    return mix(out)


def gram_first(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of the k-grams of each document, given its first words."""
    return first[:-1], np.maximum(np.diff(first) - k + 1, 0)


def within(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which k-grams of the chunk lie within one document."""
    ok = np.zeros(total, bool)
    lo, n = gram_first(first, k)
    mark = np.zeros(total + 1, np.int64)
    use = n > 0
    np.add.at(mark, lo[use], 1)
    np.add.at(mark, (lo + n)[use], -1)
    np.cumsum(mark[:-1], out=mark[:-1])
    ok[:] = mark[:-1] > 0
    return ok
