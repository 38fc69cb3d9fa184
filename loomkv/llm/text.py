"""Vectorised text primitives over Arrow string columns, shared by the operators.

A slice of rows is one contiguous byte buffer with row offsets; words are maximal runs of bytes that
are not ASCII white space, and never cross a row. Words are hashed eight bytes at a time by a chain of
bijective mixes, so that no polynomial identity (as the Thue-Morse words have) makes two of them equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
LONG = 4096


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise: every input bit reaches every output bit; a bijection."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> U64(32))


def slices(column: pa.Array | pa.ChunkedArray, target: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) over runs of rows of about `target` bytes; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + target, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = before[-1] = True
    before[1:-1] = space[:-1]
    before[offsets] = True
    after = np.empty(len(data), dtype=bool)
    after[:-1] = space[1:]
    after[-1] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    solid = ~space
    starts = np.flatnonzero(solid & before[:-1])
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, zeros past the end, as one little-endian number each."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; words of over LONG bytes by BLAKE2."""
    if not len(starts):
        return np.zeros(0, U64)
    eight, n = lanes(data), ends - starts
    h = mix((eight[starts] & MASKS[np.minimum(n, 8)]) ^ (n.astype(U64) * U64(0x9E3779B97F4A7C15)))
    at, done = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(at):
        h[at] = mix(h[at] * U64(0x9E3779B97F4A7C15) + (eight[starts[at] + done] & MASKS[np.minimum(n[at] - done, 8)]))
        done += 8
        at = at[n[at] > done]
    for k in np.flatnonzero(n > LONG):
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts - ends + counts, counts)
