"""Rows of many numbers as one compressed binary value, for shuffles of blocks instead of single numbers."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<Q")
_ITEM = struct.Struct("<cQ")


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays by byte planes (all first bytes, all second bytes, ...), compressed."""
    head = [struct.pack("<B", len(arrays))]
    planes = []
    for a in arrays:
        head.append(_ITEM.pack(a.dtype.char.encode(), len(a)))
        planes.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    raw = b"".join(head + planes)
    return _HEAD.pack(len(raw)) + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of :func:`pack`."""
    raw = pa.Codec("zstd").decompress(data[_HEAD.size :], _HEAD.unpack_from(data)[0], asbytes=True)
    count, at = raw[0], 1
    items = []
    for _ in range(count):
        items.append(_ITEM.unpack_from(raw, at))
        at += _ITEM.size
    out = []
    for char, length in items:
        kind = np.dtype(char.decode())
        size = kind.itemsize * length
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(length))
        at += size
    return out


def rising(values: np.ndarray) -> np.ndarray:
    """A sorted array as its first value and the steps after it, which compress better."""
    return np.diff(values, prepend=values.dtype.type(0))
