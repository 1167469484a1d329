"""Several arrays in one binary value: whole numbers as narrow as they go, compressed where that helps."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

KINDS = ("u1", "<u2", "<u4", "<u8", "<i8", "<f4", "<f8")


def pack(*arrays: np.ndarray) -> bytes:
    out = [struct.pack("<B", len(arrays))]
    for x in arrays:
        if x.dtype.kind == "b" or x.dtype.kind in "iu" and x.dtype != np.uint64 and (not len(x) or x.min() >= 0):
            top = int(x.max()) if len(x) else 0
            x = x.astype(KINDS[0 if top < 2**8 else 1 if top < 2**16 else 2 if top < 2**32 else 4])
        raw = x.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True) if raw else raw
        packed = len(small) < 0.95 * len(raw)
        out.append(struct.pack("<BBQQ", KINDS.index(x.dtype.str.replace("|", "")), packed, len(x), len(small) if packed else len(raw)))
        out.append(small if packed else raw)
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(raw[0]):
        kind, packed, n, size = struct.unpack_from("<BBQQ", raw, at)
        at += 18
        dtype = np.dtype(KINDS[kind])
        data = pa.decompress(raw[at : at + size], decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True) if packed else raw[at : at + size]
        x = np.frombuffer(data, dtype=dtype)
        out.append(x if kind >= 3 else x.astype(np.int64))
        at += size
    return out


def rising(x: np.ndarray) -> np.ndarray:
    """Differences of a rising array; np.cumsum undoes it."""
    return np.diff(x, prepend=0)


def grouped(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)
