"""Vectorised text kernels over Arrow string arrays: words, word hashes, shingles, minhashes.

All work on whole texts. Null texts count as empty. Nothing loops over rows in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_C1, _C2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U)
#: Letters, digits, underscore and every byte of a multi-byte character belong to words.
WORD = np.array([chr(i).isalnum() or i == 95 if i < 128 else True for i in range(256)])
#: Everything but ASCII white space.
VISIBLE = np.array([i not in b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * _C2
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def strings(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets, the first offset being 0."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - (off[0] if len(off) else 0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of about `limit` bytes of text, so that temporaries stay in the CPU's cache; a long text has a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        piece = (np.cumsum(size) - size // 2) // limit
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            yield batch.slice(lo, hi - lo)


class Words:
    """Runs of `cls` bytes: start, end (byte offsets), count[row] words, first[row] index of the first word."""

    def __init__(self, arr: pa.Array, cls: np.ndarray = WORD, lower: bool = True):
        if lower:
            arr = pc.utf8_lower(pc.fill_null(arr, ""))
        self.raw, self.off = strings(arr)
        n = len(self.raw)
        on = np.zeros(n + 2, bool)
        on[1:-1] = cls[self.raw]
        edge = self.off[(self.off < n)]
        start = on[1:-1] & ~on[:-2]
        start[edge] = on[1:-1][edge]
        end = on[1:-1] & ~on[2:]
        last = self.off[self.off > 0] - 1
        end[last] = on[1:-1][last]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)
        self.first = self.first[:-1]

    def __len__(self) -> int:
        return len(self.start)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        return hash_ranges(self.raw, self.start, self.end)


def hash_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from each start to its end, eight bytes at a time."""
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    view = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    left = end - start
    h = left.astype(U) * _C1
    h = (h ^ (view[start] & _MASK[np.minimum(left, 8)])) * _C2
    h ^= h >> U(29)
    at = np.flatnonzero(left > 8)
    pos, left = start[at] + 8, left[at] - 8
    while len(at):
        x = (h[at] ^ (view[pos] & _MASK[np.minimum(left, 8)])) * _C2
        h[at] = x ^ (x >> U(29))
        more = left > 8
        at, pos, left = at[more], pos[more] + 8, left[more] - 8
    return mix(h)


def shingles(h: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words and their number in each row; a row of fewer words has one, of all of them."""
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.cumsum(count) - count
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    size = np.repeat(np.minimum(count, k), n)
    out = size.astype(U) * _C1
    pad = np.concatenate([h, np.zeros(k, U)])
    for j in range(k):
        out = np.where(size > j, (out ^ pad[at + j]) * _C1 + (out >> U(31)), out)
    return mix(out), n


def segmented_min(values: np.ndarray, n: np.ndarray, empty: int) -> np.ndarray:
    """Minimum of each run of n[row] values; `empty` for runs of none."""
    out = np.full(len(n), empty, dtype=values.dtype)
    has = np.flatnonzero(n)
    if len(has):
        out[has] = np.minimum.reduceat(values, (np.cumsum(n) - n)[has])
    return out


def segmented_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def winnow(h: np.ndarray, n: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the minima (the last of equals) of all runs of `stretch` hashes within each row; rows with fewer give their minimum."""
    row = np.repeat(np.arange(len(n)), n)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(len(n), np.int64)
    best, width = np.arange(len(h)), 1
    value = h.copy()
    # Minima of runs of doubling width, then of two that overlap: 2 log2(stretch) vector steps.
    while width * 2 <= stretch:
        other = np.minimum(np.arange(len(h)) + width, len(h) - 1)
        take = value[other] <= value
        best, value, width = np.where(take, best[other], best), np.where(take, value[other], value), width * 2
    if width < stretch:
        other = np.minimum(np.arange(len(h)) + stretch - width, len(h) - 1)
        take = value[other] <= value
        best = np.where(take, best[other], best)
    first = np.cumsum(n) - n
    inside = np.arange(len(h)) - first[row] <= np.maximum(n[row] - stretch, 0)
    inside &= n[row] >= stretch
    short = np.flatnonzero((n > 0) & (n < stretch))
    low = segmented_min(h, n, np.iinfo(np.uint64).max)
    is_low = (h == low[row]) & np.isin(row, short)
    at = np.unique(np.concatenate([best[inside], np.flatnonzero(is_low)]))
    return at, np.bincount(row[at], minlength=len(n))


def list_array(values: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values, type=kind))
