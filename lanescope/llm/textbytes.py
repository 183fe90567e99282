"""Vectorised reading of Arrow text columns: bytes, words and hashes of stretches, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept, and made longer when needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 20), np.uint64(base))
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, n + 1 offsets). The column holds no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def slices(batch: pa.RecordBatch, column: int, limit: int = 4_000_000):
    """Parts of a batch with about `limit` bytes of text each, one row at least."""
    at = text_bytes(batch.column(column))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads close values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any stretches of one byte array, each at the cost of two look-ups. There are two families of them."""

    def __init__(self, data: np.ndarray, family: int = 0):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_RANDOM[family][data] * powers(INVERSE, n), out=self.sums[1:])
        self.up = powers(BASE, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """The hashes of all stretches of one size."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.up[:n] + np.uint64(size)) if n > 0 else np.zeros(0, np.uint64)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start, end) of every word, A-Z lowered, in order; separator: 256 booleans."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 1, bool)
    inside[:-1] = ~separator[low]
    fresh = np.zeros(len(low) + 1, bool)  # the first byte of a text
    fresh[offsets[:-1]] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | fresh))
    end = np.flatnonzero(before & (~inside | fresh))
    return Rolling(low).hash(start, end), np.searchsorted(offsets, start, "right") - 1, start, end
