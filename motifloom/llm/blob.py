"""Compact bytes for tuples of numeric arrays: narrowed, split by byte, zstd."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def _narrow(a: np.ndarray) -> np.ndarray:
    if a.dtype.kind not in "iu" or not len(a):
        return a
    if a.dtype.kind == "i" and int(a.min()) < 0:
        return a.astype(np.int64)
    return a.astype(np.min_scalar_type(int(a.max())))


def pack(*arrays: np.ndarray) -> bytes:
    """Bytes of the arrays. Sorted unsigned 64-bit arrays are kept as differences."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        rising = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        kept = _narrow(np.r_[a[:1], np.diff(a)] if rising else a)
        raw = np.ascontiguousarray(kept).view(np.uint8).reshape(len(kept), -1).T.tobytes() if len(kept) else b""
        body = _CODEC.compress(raw, asbytes=True)
        out.append(struct.pack("<3s3s?QQ", a.dtype.str[-2:].encode(), kept.dtype.str[-2:].encode(), rising, len(a), len(body)))
        out.append(body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    (n,), at, out, head = struct.unpack_from("<B", data), 1, [], struct.calcsize("<3s3s?QQ")
    for _ in range(n):
        kind, kept, rising, length, size = struct.unpack_from("<3s3s?QQ", data, at)
        at += head
        kept_type = np.dtype(kept.rstrip(b"\0").decode())
        raw = _CODEC.decompress(data[at : at + size], decompressed_size=length * kept_type.itemsize, asbytes=True) if length else b""
        at += size
        a = np.frombuffer(raw, np.uint8).reshape(kept_type.itemsize, length).T.copy().view(kept_type).reshape(length) if length else np.zeros(0, kept_type)
        a = a.astype(np.dtype(kind.rstrip(b"\0").decode()))
        out.append(np.cumsum(a, dtype=np.uint64) if rising else a)
    return out
