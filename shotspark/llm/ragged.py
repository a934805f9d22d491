"""Lists of unequal length as one flat array with starts and lengths, and byte
blobs that keep numeric columns small."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The lists named by ``index``, one after the other."""
    size = length[index]
    total = int(size.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(size)
    return flat[np.repeat(start[index] - (ends - size), size) + np.arange(total)]


def planes(x: np.ndarray) -> bytes:
    """An unsigned integer array by byte planes, for a compressor."""
    width = x.dtype.itemsize
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, width).T.tobytes()


def from_planes(raw, dtype, n: int, at: int = 0) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(dtype).ravel()


def squeeze(*parts: bytes) -> bytes:
    """Byte strings, framed by their lengths and compressed together."""
    raw = b"".join([len(parts).to_bytes(4, "little"), *(len(p).to_bytes(8, "little") for p in parts), *parts])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(blob: bytes) -> list[memoryview]:
    raw = memoryview(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))
    n = int.from_bytes(raw[:4], "little")
    sizes = [int.from_bytes(raw[4 + 8 * k:12 + 8 * k], "little") for k in range(n)]
    out, at = [], 4 + 8 * n
    for s in sizes:
        out.append(raw[at:at + s])
        at += s
    return out
