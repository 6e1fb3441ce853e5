"""Vectorised text kernel: Arrow string columns to words, hashes and byte windows.

Everything here works on bounded slices of an Arrow batch, so the memory of a
task does not depend on how many rows Spark puts into a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, dtype=bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False

#: Digits, letters and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_SEED = U(0x9C1F3A75D2E84B63)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Slice:
    """Some rows of a batch: their UTF-8 bytes back to back, and where each row starts."""

    def __init__(self, first: int, data: np.ndarray, offs: np.ndarray):
        self.first, self.data, self.offs = first, data, offs
        self.rows = len(offs) - 1
        self._chunks: dict[bool, np.ndarray] = {}

    def lowered(self) -> np.ndarray:
        return _LOWER[self.data]

    def chunks(self, lower: bool) -> np.ndarray:
        """The eight bytes from each position on as one little-endian integer; zeros follow the end."""
        if lower not in self._chunks:
            padded = np.zeros(len(self.data) + 8, dtype=np.uint8)
            padded[: len(self.data)] = self.lowered() if lower else self.data
            self._chunks[lower] = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
        return self._chunks[lower]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """64-bit hashes of the byte ranges [start, end), eight bytes at a time through `mix`.

        Two different ranges get the same hash with a chance of about 2**-64.
        """
        words, left = self.chunks(lower), ends - starts
        out = mix(left.astype(U) ^ _SEED)
        todo, at = np.arange(len(starts)), starts
        while len(todo):
            part = words[at] & _MASK[np.minimum(left, 8)]
            out[todo] = mix((out[todo] ^ part) * U(0x9E3779B97F4A7C15))
            more = np.flatnonzero(left > 8)
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        return out

    def sliding(self, size: int) -> np.ndarray:
        """Hashes of all byte strings of this size, a multiple of eight, those across rows included."""
        words, n = self.chunks(False), len(self.data) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=U)
        out = words[:n] * U(0xD6E8FEB86659FD93)
        for k in range(8, size, 8):
            out ^= out >> U(29)
            out += words[k : k + n]
            out *= U(0xD6E8FEB86659FD93)
        return mix(out)

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """Count of set bytes in each row."""
        c = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]

    def words(self, table: np.ndarray = _SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of all runs of bytes in `table`; by default those outside 0x20 and 0x09-0x0D."""
        n = len(self.data)
        if not n:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        solid = table[self.data]
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = False, solid[:-1]
        inner = self.offs[:-1]
        before[inner[inner < n]] = False
        after = np.empty(n, dtype=bool)
        after[-1], after[:-1] = False, solid[1:]
        last = self.offs[1:] - 1
        after[last[last >= 0]] = False
        starts = np.flatnonzero(solid & ~before)
        ends = np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(self.offs, starts, side="right") - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string or binary column into slices of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield Slice(at, data[offs[at] : offs[end]], (offs[at : end + 1] - offs[at]).astype(np.int64))
        at = end


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all n-word windows that stay within one row."""
    if len(h) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    m = len(h) - n + 1
    ok = np.flatnonzero(row[:m] == row[n - 1 :])
    out = np.zeros(len(ok), dtype=U)
    for i in range(n):
        out = out * U(0x9E3779B97F4A7C15) + mix(h[ok + i] + U(i + 1))
    return ok, mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed integers, as Spark's long has no sign-free form."""
    return x.view(np.int64)
