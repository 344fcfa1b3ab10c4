"""Compact binary columns for tables of words and codes that move between tasks."""

from __future__ import annotations

import numpy as np
import zstandard


def squeeze(*parts: bytes, level: int = 3) -> bytes:
    """Several byte strings as one compressed one."""
    heads = np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(heads + b"".join(parts))


def unsqueeze(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [raw[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def pack_codes(codes: np.ndarray) -> bytes:
    """Non-negative integers, small ones in fewer bytes of seven bits.

    All first bytes come first, then all second ones: each kind compresses by its own statistics.
    """
    planes, rest = [np.array([len(codes)], dtype=np.int64).tobytes()], codes.astype(np.uint64)
    while len(rest):
        more = rest >= 128
        planes.append(((rest & np.uint64(127)) | (more.astype(np.uint64) << np.uint64(7))).astype(np.uint8).tobytes())
        rest = rest[more] >> np.uint64(7)
    return b"".join(planes)


def unpack_codes(data: bytes) -> np.ndarray:
    n, at, shift = int(np.frombuffer(data, np.int64, 1)[0]), 8, 0
    total, where = np.zeros(n, dtype=np.int64), np.arange(n)
    while len(where):
        plane = np.frombuffer(data, np.uint8, len(where), at)
        total[where] |= (plane & 127).astype(np.int64) << shift
        at, shift = at + len(where), shift + 7
        where = where[plane >= 128]
    return total


def pack_strings(items: list[bytes]) -> tuple[bytes, bytes]:
    return pack_codes(np.fromiter(map(len, items), np.int64, len(items))), b"".join(items)


def unpack_strings(sizes: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(unpack_codes(sizes)).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
