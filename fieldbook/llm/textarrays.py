"""Text columns as numpy arrays: tokens, word hashes and n-gram hashes of whole Arrow batches.

Everything works on the UTF-8 bytes of many documents at once, in pieces of about PIECE bytes so
that the temporaries stay in cache however long the batch is. A document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(keep) -> np.ndarray:
    """A 256-entry table that is True for the bytes (after lower-casing) that belong to a word."""
    return np.array([bool(keep(b)) for b in range(256)])


#: letters, digits and everything beyond ASCII
ALNUM = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: everything but space and the controls from tab to carriage return
SOLID = byte_class(lambda b: not (b == 32 or 9 <= b <= 13))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two rounds of xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse mod 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, 2 * PIECE)
        for k, base in enumerate((_BASE, _INVERSE)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=np.uint64)
    return _powers[0], _powers[1]


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into those bytes) for consecutive rows; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(at, at[row] + PIECE, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


@dataclass
class Words:
    """The words of a piece: byte bounds, the piece's row of each, and the rows' bounds in words."""

    lower: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    bounds: np.ndarray  # word index where each row starts, and the total

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.lower) + 1)
        total = np.zeros(len(self.lower) + 1, np.uint64)
        np.cumsum((self.lower.astype(np.uint64) + np.uint64(1)) * up[: len(self.lower)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])


def split_words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of table's bytes, never across rows; A-Z are lower-cased first."""
    low = LOWER[raw] if lower else raw
    rows = len(offsets) - 1
    if not len(low):
        none = np.zeros(0, np.int64)
        return Words(low, none, none, none, np.zeros(rows + 1, np.int64))
    inside = table[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    return Words(low, start, end, np.repeat(np.arange(rows), np.diff(bounds)), bounds)


def exact(words: Words, table: np.ndarray) -> pa.DictionaryArray:
    """The words themselves, as codes into their distinct strings; table is the one they were split by."""
    offsets = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int32)
    solid = np.ascontiguousarray(words.lower[table[words.lower]])
    return pa.StringArray.from_buffers(len(words.start), pa.py_buffer(offsets), pa.py_buffer(solid)).dictionary_encode()


_STEP = np.uint64(0xD6E8FEB86659FD93)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive entries of h, wherever they lie."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, step = np.zeros(count, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            out += h[j : j + count] * step
            step = step * _STEP
        return mix(out + np.uint64(n) * np.uint64(0xA24BAED4963EE407))


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-word runs (a row of fewer words, but not none: all of it as one), and row bounds."""
    h, counts = words.hashes(), np.diff(words.bounds)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(bounds[-1], np.uint64)
    full = windows(h, n)
    whole = np.flatnonzero(counts >= n)
    if len(whole):
        take = np.ones(bounds[-1], bool)
        take[bounds[:-1][(counts > 0) & (counts < n)]] = False
        starts = words.bounds[:-1][whole]
        lengths = made[whole]
        index = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
        out[take] = full[index]
    for row in np.flatnonzero((counts > 0) & (counts < n)):
        out[bounds[row]] = windows(h[words.bounds[row] : words.bounds[row + 1]], int(counts[row]))[0]
    return out, bounds


def code_points(raw: np.ndarray) -> np.ndarray:
    """For each byte offset (and the end), how many code points lie before it."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out
