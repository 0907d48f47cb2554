"""Vectorised text primitives shared by the corpus operators.

Everything works on the UTF-8 bytes of an Arrow string column: whole blocks of
documents are handled by numpy at once and no Python object is made per word.
Blocks are bounded in bytes, so memory does not depend on the size of a batch;
only a single document longer than a block is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled by one vectorised step.
BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20_240_611)
#: Fixed random values of the 256 byte values, one table for each of two independent hashes.
BYTE_VALUES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd multipliers (congruent to 5 modulo 8) of the polynomial hashes over bytes and over words.
BYTE_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED05))
WORD_BASE = (np.uint64(0xBF58476D1CE4E5B5), np.uint64(0x94D049BB133111ED))

#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large_string, null as the empty text."""
    a = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(a.cast(pa.large_string()), "")


def bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (uint8) and offsets (int64, from 0) of a large_string array without nulls."""
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    o = np.frombuffer(off, np.int64, len(a) + 1, a.offset * 8)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def blocks(a: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one longer row."""
    data, off = bytes_of(a)
    i, n = 0, len(a)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the published splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept, and grown when needed."""
    p = _powers.get(int(base))
    if p is None or len(p) < n:
        size = max(n, BLOCK_BYTES + 64)
        p = np.empty(size, np.uint64)
        p[0] = 1
        p[1:] = base
        np.multiply.accumulate(p, out=p)
        _powers[int(base)] = p
    return p[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def segments(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and the offsets of the documents in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = sep[data]
    full = off[:-1] < off[1:]
    start = ~gap
    end = start.copy()
    start[1:] &= gap[:-1]
    end[:-1] &= gap[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    start[first] = ~gap[first]
    end[last] = ~gap[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, which: int = 0, sep: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = np.where(sep, np.uint64(0), BYTE_VALUES[which])
    terms = values[data]
    terms *= powers(BYTE_BASE[which], len(data))
    h = np.add.reduceat(terms, starts)
    return mix(h * powers(inverse(BYTE_BASE[which]), len(data))[starts])


def window_hashes(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``size`` consecutive values (across document limits too: the caller leaves those out)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(which)) * powers(WORD_BASE[which], len(h)), out=s[1:])
    return mix((s[size:] - s[:-size]) * powers(inverse(WORD_BASE[which]), n))


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: the run of each element, and its place in the run."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - begin[run]
