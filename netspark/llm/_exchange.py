"""Dealing out 64-bit keys between tasks in packed rows.

A map task sorts the keys of a slice of documents and writes one row for each
part of the key space that they fall into: the sorted keys as differences in
byte planes (which the shuffle's codec shrinks well), and beside each key the
number of the entry it comes from. One packed row stands for thousands of
keys, so a shuffle of all keys of a corpus costs a few bytes and nanoseconds
a key. Parts are ranges of hashes, hence even.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key; it never falls as keys rise."""
    return ((keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(U64, copy=False)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as count, width, first key and planes of differences."""
    n = len(keys)
    steps = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return np.array([n, width, int(keys[0]) if n else 0], "<u8").tobytes() + _planes(steps, width)


def unpack_sorted(blob: bytes) -> np.ndarray:
    n, width, first = (int(x) for x in np.frombuffer(blob, "<u8", 3))
    steps = _from_planes(np.frombuffer(blob, np.uint8, n * width, 24), n, width)
    with np.errstate(over="ignore"):
        return np.cumsum(steps, dtype=U64) + U64(first)


def pack_small(values: np.ndarray) -> bytes:
    """Non-negative numbers in as many bytes as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return np.array([len(values), width], "<u4").tobytes() + _planes(values, width)


def unpack_small(blob: bytes) -> np.ndarray:
    n, width = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    return _from_planes(np.frombuffer(blob, np.uint8, n * width, 8), n, width).astype(np.int64)


def cuts(sorted_keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the parts that sorted keys fall into."""
    if not len(sorted_keys):
        return []
    part = part_of(sorted_keys, parts)
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    return [(int(part[a]), int(a), int(e)) for a, e in zip(at[:-1], at[1:], strict=True)]
