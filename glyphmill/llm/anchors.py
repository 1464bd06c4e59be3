"""Where long repeats may lie: texts cut into segments by the least hash within each window."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of the grams whose hashes are compared.
GRAM = 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes that start at each position."""
    n = len(raw) - GRAM + 1
    words = np.lib.stride_tricks.as_strided(np.ascontiguousarray(raw), (len(raw) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    h = words[:n] * _A
    h ^= h >> np.uint64(29)
    h += words[8 : 8 + n] * _B
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(29)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(h) - width + 1
    if width == 1:
        return h
    size = -(-len(h) // width) * width
    padded = np.full(size, np.uint64(2**64 - 1))
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def segments(data: bytes, length: int):
    """Cuts a text into ``(key, start, windows, inner)``.

    Each segment is a maximal run of windows (starts of ``length``-byte
    strings) with the same least gram hash, its key.  Equal windows have equal
    keys wherever they stand, and every window lies in exactly one segment,
    whose text is ``data[start : start + windows + length - 1]``.  ``inner``
    tells whether the key's gram occurs twice, without which no two windows of
    the segment are equal.
    """
    if len(data) < length:
        return []
    h = gram_hashes(np.frombuffer(data, np.uint8))
    width = length - GRAM + 1
    least = sliding_min(h, width)
    start = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    windows = np.diff(np.append(start, len(least)))
    keys = least[start]
    out = []
    for k, s, w in zip(keys, start.tolist(), windows.tolist()):
        inner = w > width or np.count_nonzero(h[s : s + w + width - 1] == k) > 1
        out.append((int(k.view(np.int64)), s, w, bool(inner)))
    return out


def segment_hash(data: bytes, start: int, windows: int, length: int) -> bytes:
    return xxhash.xxh3_128_digest(data[start : start + windows + length - 1])
