"""Arrays of whole numbers as short bytes: byte planes of equal weight together, compressed."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import zstandard


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers as bytes; ``expand`` gives them back as unsigned 64-bit ones."""
    x = np.ascontiguousarray(x).astype(np.int64 if x.dtype.kind in "bi" else np.uint64).view(np.uint64)
    if not len(x):
        return b""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(np.uint64).ravel()


def join_parts(parts: Iterable[bytes]) -> bytes:
    parts = list(parts)
    return np.array([len(parts), *(len(p) for p in parts)], "<u4").tobytes() + b"".join(parts)


def split_parts(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = 4 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)])
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
