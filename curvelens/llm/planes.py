"""Arrays of numbers as short bytes, for rows that are staged and shuffled."""

from __future__ import annotations

import numpy as np
import zstandard

OUT, IN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray | bytes) -> bytes:
    return OUT.compress(x if isinstance(x, bytes) else x.tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(IN.decompress(b, max_output_size=1 << 31) if b else b"", kind)


def planes(x: np.ndarray) -> bytes:
    """Packed byte by byte: sorted and small numbers take little room."""
    return OUT.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unplanes(b: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(x: np.ndarray) -> bytes:
    """Numbers that mostly rise, as planes of their differences."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def unsteps(b: bytes, kind) -> np.ndarray:
    return np.cumsum(unplanes(b, kind), dtype=kind)
