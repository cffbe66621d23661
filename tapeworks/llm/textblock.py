"""Vectorised words, shingles and hashes of Arrow batches of text.

Everything here works on whole batches of UTF-8 bytes with numpy: a batch is cut into blocks of a few megabytes
(a longer text is a block of its own), so memory follows the block size or the longest text, never the partition.
Words are maximal runs of bytes other than the six ASCII white-space bytes, which never occur inside a
multi-byte UTF-8 character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

try:  # glibc: arrays of a megabyte or more go back to the system when freed, so that reused workers stay small
    ctypes.CDLL(None).mallopt(-3, 1 << 20)
    pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pools keep what batches of tens of megabytes have freed
except (AttributeError, OSError):
    pass

IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of the hash base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 1024), _BASE, np.uint64)
        step[0] = 1
        _powers = np.cumprod(step, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) over a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + block_bytes, "right")) - 1)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Words:
    """Words of a block: starts, ends (byte positions) and first (index of each text's first word, n + 1 long)."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = False, table: np.ndarray = IS_WORD):
        self.raw = LOWER[raw] if lower else raw
        self.inside = inside = table[raw]
        begin, end = inside.copy(), inside.copy()
        if len(raw):
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            edges = offs[:-1][offs[:-1] < offs[1:]]
            begin[edges] = inside[edges]
            last = offs[1:][offs[:-1] < offs[1:]] - 1
            end[last] = inside[last]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """Text index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes, the same in every process and block."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        at = np.concatenate(([0], np.cumsum(lens)[:-1]))
        place = np.arange(int(lens.sum())) - np.repeat(at, lens)
        values = _TABLE[self.raw[self.inside]] * powers(int(lens.max()))[place]
        return mix(np.add.reduceat(values, at) + lens.astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def bytes_of(self, index: np.ndarray) -> list[bytes]:
        """Bytes of chosen words."""
        whole = self.raw.tobytes()
        return [whole[s:e] for s, e in zip(self.starts[index].tolist(), self.ends[index].tolist(), strict=True)]


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay inside a text, and each text's first window (n + 1 long)."""
    count = np.diff(first)
    if len(h) >= n:
        acc = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            acc = mix(acc * _U(_BASE) + h[j : len(h) - n + 1 + j])
        rows = np.repeat(np.arange(len(count)), count)
        good = rows[: len(h) - n + 1] == rows[n - 1 :]
        acc = acc[good]
    else:
        acc = np.zeros(0, np.uint64)
    return acc, np.concatenate(([0], np.cumsum(np.maximum(count - n + 1, 0))))


def shingle_sets(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles, lower-cased A-Z, and offsets by text.

    A text of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    words = Words(raw, offs, lower=True)
    h, first = words.hashes(), words.first
    grams, at = ngrams(h, first, n)
    sets: list[np.ndarray] = []
    for i in range(len(offs) - 1):
        if at[i + 1] > at[i]:
            one = np.sort(grams[at[i] : at[i + 1]])
            if len(one) > 1:
                keep = np.empty(len(one), bool)
                keep[0] = True
                np.not_equal(one[1:], one[:-1], out=keep[1:])
                one = one[keep]
        elif first[i + 1] > first[i]:
            short = h[first[i] : first[i + 1]]
            one = np.array([len(short)], np.uint64)
            for j in range(len(short)):
                one = mix(one * _U(_BASE) + short[j])
        else:
            one = np.zeros(0, np.uint64)
        sets.append(one)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def segment_sum(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum by segment; an empty segment sums to 0."""
    out = np.zeros(len(offs) - 1, values.dtype)
    full = offs[1:] > offs[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offs[:-1][full])
    return out
