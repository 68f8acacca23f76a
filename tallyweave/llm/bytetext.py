"""Vectorised work on the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once: bounds the 8-byte-per-character intermediates.
PIECE = 1 << 20


def give_back() -> None:
    """Returns memory that a task has freed to the system: workers live on, and the next task may need little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offset of each text, or binary value, and of the end); a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary()).fill_null(b"") if binary else column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+`` (or run of bytes that aren't ``space``), and each text's first word (and the end)."""
    solid = ~space[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = at[:-1] < at[1:]
    heads, tails = at[:-1][full], at[1:][full] - 1
    begin[heads], end[tails] = solid[heads], solid[tails]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


class WordHash:
    """64-bit polynomial hashes of byte spans, by prefix sums; seeds give independent families."""

    def __init__(self, seed: int) -> None:
        rule = splitmix(np.arange(seed * 1000 + 1, seed * 1000 + 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.values, base = rule[:256], int(rule[256]) | 1
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, x in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
            a, b = starts[i], ends[j - 1]
            self.powers(int(b - a) + 1)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(self.values[data[a:b]] * self.up[: b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = splitmix((sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64))
            i = j
        return out
