"""Words of Arrow text columns as numpy arrays: no Python object is made for a word.

Everything here works on slices of about SLICE bytes so that temporaries stay
small whatever the size of an Arrow batch; a longer document is a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

#: Bytes that a word consists of.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = data - np.uint8(0x41) < 26  # bytes below A wrap around
    return data + (upper.view(np.uint8) << np.uint8(5))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, SLICE * 2)
        _POW = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _P), dtype=np.uint64)])
        _INV = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _P_INV), dtype=np.uint64)])
    return _POW, _INV


def _ranged(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of values[start:end] for each pair, by one prefix sum."""
    pw, inv = powers(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.multiply(values, pw[: len(values)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts])


def column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary or string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    n = len(col)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def slices(offs: np.ndarray, target: int = SLICE):
    """Ranges (lo, hi) of documents of about target bytes."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """The words of a slice: starts and ends in data, first[d]:first[d + 1] for document d of the slice."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray):
        self.data, self.offs = data, offs
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = np.frombuffer(data.tobytes().translate(table.tobytes()), bool)
        at = offs[(offs > 0) & (offs < n)]
        before, after = inside[:-2], inside[2:]
        first = inside[1:-1] & ~before
        last = inside[1:-1] & ~after
        if len(at):
            first[at] = inside[1:-1][at]
            last[at - 1] = inside[1:-1][at - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return _ranged(_BYTE.take(self.data.astype(np.intp)), self.starts, self.ends)

    def room(self, n: int) -> np.ndarray:
        """Whether n words from this one on are in its document."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self))
        return left >= n


def windows(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position in at; they must exist."""
    return _ranged(hashes, at, at + n)


def read(batch_col, table: np.ndarray = SPACED, lower: bool = False, target: int = SLICE):
    """(lo, hi, Words) for each slice of a column."""
    offs, data = column(batch_col)
    for lo, hi in slices(offs, target):
        part = data[offs[lo] : offs[hi]]
        yield lo, hi, Words(lower_ascii(part) if lower else part, offs[lo : hi + 1] - offs[lo], table)
