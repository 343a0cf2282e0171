"""Words of UTF-8 text as numpy arrays, found and hashed a slice of rows at a time.

Word classes are given by byte: every byte of a multi-byte character is 0x80 or more, so a class that takes all
characters from U+0080 on is the same for bytes as for characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: 0-9, a-z after lower-casing, and every character from U+0080 on.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but blank, tab, line feed, vertical tab, form feed and carriage return.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))

#: Bytes whose words are hashed at a time, about: sums and powers take some 30 bytes for each.
PIECE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))]) for x in (_BASE, _INVERSE))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    found = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return found[at[0] : at[-1]], at - at[0]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over the bytes, from which span_hashes() has the hash of any span."""
    up, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, mixed with its length; the same wherever the span stands."""
    _, down = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Words:
    """All words of a slice: ``starts`` and ``ends`` in ``data``; words of row i are ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, column: pa.Array, kind: np.ndarray, lower: bool = True):
        data, offsets = raw(column)
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = kind[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        if len(inside):
            begins = offsets[:-1][offsets[:-1] < offsets[1:]]
            first[begins] = inside[begins]
            ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            last[ends] = inside[ends]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, first: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its ``first`` bytes; a piece of the words at a time."""
        ends = self.ends if first is None else np.minimum(self.ends, self.starts + first)
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + PIECE, "right")))
            part = slice(at, to)
            out[part] = span_hashes(prefix_sums(self.data[base : self.ends[to - 1]]), self.starts[part] - base, ends[part] - base)
            at = to
        return out

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of the whole sequence if it is shorter, but not empty."""
    n = min(n, len(hashes))
    if n == 0:
        return hashes
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = mix(out + hashes[j : len(hashes) - n + 1 + j])
    return out
