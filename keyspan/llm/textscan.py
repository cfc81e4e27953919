"""Vectorised word scanning of Arrow text columns.

A batch of texts is handled as one byte buffer: word borders, word hashes and
n-gram hashes are numpy expressions over the buffer, so Python runs once a chunk
and not once a word.  Words are runs of bytes other than U+0020 and U+0009-U+000D;
a null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_MIX = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
#: Classes of bytes: 0 between words, else words end where the class changes.
_PLAIN = np.ones(256, np.uint8)
_PLAIN[[9, 10, 11, 12, 13, 32]] = 0
_MARKED = _PLAIN.copy()
_MARKED[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> _S32)) * _MIX
    x = (x ^ (x >> _S32)) * _MIX
    return x ^ (x >> _S32)


@lru_cache(2)
def _byte_table(lower: bool) -> np.ndarray:
    table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    if lower:
        table = table.copy()
        table[65:91] = table[97:123]
    return table


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _BASE, np.uint64)
    down = np.full(n + 1, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@dataclass
class Words:
    """The words of texts lo..hi of a batch.  starts/ends are byte places in buf; first[d]..first[d+1] are text d's words."""

    lo: int
    hi: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    lower: bool

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; long chunks are hashed piece by piece."""
        out = np.empty(len(self.starts), np.uint64)
        table, at = _byte_table(self.lower), 0
        while at < len(out):
            to = int(np.searchsorted(self.starts, self.starts[at] + CHUNK_BYTES))
            to = max(at + 1, to)
            begin, end = int(self.starts[at]), int(self.ends[to - 1])
            size = 2 * CHUNK_BYTES if end - begin <= 2 * CHUNK_BYTES else end - begin
            up, down = _powers(size)
            sums = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(table[self.buf[begin:end]] * up[: end - begin], out=sums[1:])
            s, e = self.starts[at:to] - begin, self.ends[at:to] - begin
            out[at:to] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
        return out

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def scan_words(column: pa.Array, lower: bool, marks: bool = False) -> Iterator[Words]:
    """Words of all texts, a chunk of about a MB (or one longer text) at a time.  With marks, runs of ASCII punctuation are words of their own."""
    classes = _MARKED if marks else _PLAIN
    data, offsets = text_buffers(column)
    n, lo = len(column), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, n)
        buf = data[offsets[lo] : offsets[hi]]
        borders = offsets[lo : hi + 1] - offsets[lo]
        kind = classes[buf]
        word = kind > 0
        starts = word.copy()
        starts[1:] &= kind[1:] != kind[:-1]
        inner = borders[:-1][borders[:-1] < len(buf)]
        starts[inner] = word[inner]
        ends = word.copy()
        ends[:-1] &= kind[1:] != kind[:-1]
        last = borders[1:][borders[1:] > 0] - 1
        ends[last] = word[last]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        yield Words(lo, hi, buf, starts, ends, np.searchsorted(starts, borders), lower)
        lo = hi


def grams(hashes: np.ndarray, k: int, seed: int = 0xC2B2AE3D27D4EB4F, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of k consecutive words from each word on, or from those at `at` (shorter by k-1; borders of texts aren't looked at)."""
    n = len(hashes) - k + 1 if at is None else len(at)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(seed) + (hashes[j : j + n] if at is None else hashes[at + j])
    return mix64(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of w consecutive values from each place on, by doubling."""
    if len(x) < w:
        return x[:0]
    got, cur = 1, x
    while 2 * got <= w:
        cur, got = np.minimum(cur[:-got], cur[got:]), 2 * got
    if got < w:
        n = len(x) - w + 1
        cur = np.minimum(cur[:n], cur[w - got : w - got + n])
    return cur[: len(x) - w + 1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(batches, rows: int = 1000):
    """Batches cut to so many rows at most, so that what Python holds of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
