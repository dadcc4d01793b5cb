"""Vectorised word splitting and hashing over Arrow string columns.

Words are the maximal runs of bytes other than space and 0x09-0x0D. A column is
handled in blocks of a few megabytes, so the temporary arrays stay small
whatever the size of an Arrow batch; one text is never split over two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_BLOCK_BYTES = 2_000_000
_POWERS_STEP = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One ordered 64-bit hash of two."""
    return mix(a * U64(0xD6E8FEB86659FD93) + mix(b + U64(0x632BE59BD9B4E019)))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _ODD)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n-1 modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), U64)
    have, step = 1, base & 0xFFFFFFFFFFFFFFFF
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * U64(step)
        have, step = have + take, step * step & 0xFFFFFFFFFFFFFFFF
    return out


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_cache: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    if name not in _cache or len(_cache[name]) < n:
        _cache[name] = _powers(base, -(-n // _POWERS_STEP) * _POWERS_STEP)
    return _cache[name][:n]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans raw[start:end]; equal spans have equal hashes."""
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE[raw] * _table("up", _BASE, len(raw)), out=total[1:])
    h = (total[end] - total[start]) * _table("down", _INVERSE, len(raw) + 1)[start]
    return mix(h + (end - start).astype(U64) * _ODD)


class Block(NamedTuple):
    """A run of rows: their bytes, and the words in them."""

    first: int  # the first row's place in the column
    rows: int
    raw: np.ndarray  # bytes, lower-cased if asked for
    offsets: np.ndarray  # of rows in raw, rows + 1
    valid: np.ndarray  # per row
    start: np.ndarray  # of words in raw
    end: np.ndarray
    row: np.ndarray  # the words' row, from 0
    bounds: np.ndarray  # of rows in words, rows + 1

    def hashes(self) -> np.ndarray:
        return span_hashes(self.raw, self.start, self.end)


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column


def blocks(column: pa.Array, *, lower: bool = False, block_bytes: int = _BLOCK_BYTES, space: np.ndarray = SPACE) -> Iterator[Block]:
    """The column's rows in blocks; a null row counts as an empty text that is not valid. space: of the 256 bytes, those between words."""
    column = text_column(column)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1 + column.offset)[column.offset :]
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1)
        to = min(to, n)
        raw = everything[offsets[at] : offsets[to]]
        own = offsets[at : to + 1] - offsets[at]
        if lower:
            raw = LOWER[raw]
        yield _block(at, raw, own, valid[at:to], space)
        at = to


def _block(first: int, raw: np.ndarray, own: np.ndarray, valid: np.ndarray, space: np.ndarray) -> Block:
    rows = len(own) - 1
    solid = ~space[raw]
    cut = np.zeros(len(raw) + 1, bool)  # a row begins here
    cut[own] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, own)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    return Block(first, rows, raw, own, valid, start, end, row, bounds)


def crc32_of_ids(ids: pa.Array) -> np.ndarray:
    """crc32 of each id as decimal text; of a null as of the empty text."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) for x in ids.to_pylist()), np.int64, len(ids))


def rows_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; 0 for empty runs."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def summed(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their weights (1 each if None)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(weights[order], first)
