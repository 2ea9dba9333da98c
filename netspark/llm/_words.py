"""Vectorised word splitting and hashing over Arrow string columns.

Text is never decoded: a 256-entry byte table says which UTF-8 bytes belong to
words (and what they fold to), so every word class used here, being a class of
ASCII separators, is exact on whole texts of any length.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64

# Arrays of some MB go back to the system as soon as they are freed; else the C library
# keeps more and more of them, and idle Python workers hold memory that executors lack.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD

#: Odd multipliers of the rolling hashes, with their inverses modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20
#: Bytes or words whose hashes are summed at once: 64-bit scratch space follows this,
#: not the text. A text of any length costs about a dozen bytes a byte.
STRETCH = 1 << 18


def _table(separators: list[tuple[int, int]], fold: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.int64)
    if fold:
        table[65:91] += 32
    for low, high in separators:
        table[low : high + 1] = -1
    return table


#: Words are runs of anything but ASCII white space.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)], fold=False)
SPACED_LOWER = _table([(0x20, 0x20), (0x09, 0x0D)], fold=True)
#: Words are runs of a-z after folding, digits and everything beyond ASCII.
ALNUM_LOWER = _table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], fold=True)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(STRETCH + 64, n)
        with np.errstate(over="ignore"):
            each = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (base, pow(base, -1, 1 << 64))]
        _powers[base] = have = (each[0], each[1])
    return have


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019)) | U64(1)


@dataclass
class Words:
    """The words of some rows: word j of row i is at first[i] + j."""

    data: np.ndarray  #: bytes of all texts
    text_at: np.ndarray  #: byte offsets of the rows, one more than rows
    start: np.ndarray  #: byte offset of each word
    end: np.ndarray
    hash: np.ndarray  #: 64-bit hash of each folded word
    first: np.ndarray  #: index of the first word of each row, one more than rows

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def split(column: pa.Array, table: np.ndarray = SPACED) -> Words:
    """Split and hash the words of every text of a string column."""
    data, at = buffers(column)
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = (table >= 0)[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    edges = at[:-1]
    edges = edges[edges < n]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    stops = inside[1:] ^ True
    stops &= inside[:n]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner <= n)]
    stops[inner - 1] = inside[inner - 1]
    end = np.flatnonzero(stops) + 1
    h, value, j = np.empty(len(start), U64), _BYTE_VALUES[np.maximum(table, 0)], 0
    while j < len(start):  # whole words, of about a stretch of bytes together
        low = int(start[j])
        to = max(j + 1, int(np.searchsorted(end, low + STRETCH, side="right")))
        size = int(end[to - 1]) - low
        up, down = powers(BYTE_BASE, size + 1)
        total = np.zeros(size + 1, U64)
        a, e = start[j:to] - low, end[j:to] - low
        with np.errstate(over="ignore"):
            np.cumsum(value[data[low : low + size]] * up[:size], out=total[1:])
            h[j:to] = mix((total[e] - total[a]) * down[a] + (e - a).astype(U64) * U64(0xA24BAED4963EE407))
        j = to
    return Words(data, at, start, end, h, np.searchsorted(start, at))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive hashes (across rows too; callers mask)."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    up, down = powers(WORD_BASE, min(n, STRETCH + k) + 1)
    out = np.empty(n - k + 1, U64)
    for a in range(0, len(out), STRETCH):
        part = h[a : a + STRETCH + k - 1]
        total = np.zeros(len(part) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum((mix(part ^ U64(seed)) if seed else part) * up[: len(part)], out=total[1:])
            out[a : a + STRETCH] = mix((total[k:] - total[:-k]) * down[: len(part) - k + 1] + U64(k))
    return out


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold at most `most` bytes (or one row)."""
    _, at = buffers(batch.column(batch.schema.get_field_index(text)))
    row, n = 0, batch.num_rows
    while row < n:
        to = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield batch.slice(row, min(to, n) - row)
        row = to
