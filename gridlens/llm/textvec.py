"""Vectorised byte-level text work inside Arrow batches.

Texts stay UTF-8 bytes in one array per slice; words, lines and their hashes are found with numpy over all
documents of the slice at once. Null texts are empty. Every byte of every text is read; slices only bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BYTES = np.arange(256)
#: Bytes that are not ASCII white space (space and \t \n \v \f \r).
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Bytes of ASCII digits, lower-case letters and all of UTF-8 beyond ASCII.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
NOT_NEWLINE = _BYTES != 10
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SAME = _BYTES.astype(np.uint8)

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_PLACE = np.arange(1, 65, dtype=np.uint64) * _PRIME
_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; row i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text stands alone and whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Runs:
    """Maximal runs of bytes of one class within each text: words, or lines without their breaks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: np.ndarray = SAME):
        self.data, self.offsets, self.fold = data, offsets, fold
        inside = member[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        before[cuts] = False
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: The row each run lies in, and how many runs each row has.
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.per_row = np.bincount(self.row, minlength=len(offsets) - 1)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, part: int = 1 << 19) -> np.ndarray:
        """A 64-bit hash of each run's folded bytes; equal runs have equal hashes in any batch or process."""
        out = np.empty(len(self), np.uint64)
        lengths = self.end - self.start
        ends = np.cumsum(lengths)
        i = 0
        while i < len(self):
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + part, side="right")))
            size = lengths[i:j]
            first = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(first, size)
            value = _BYTE_HASH[self.fold[self.data[place + np.repeat(self.start[i:j], size)]]]
            powers = np.full(int(size.max()), _PRIME | np.uint64(1), np.uint64)
            powers[0] = 1
            value = value * np.cumprod(powers, dtype=np.uint64)[place]
            out[i:j] = np.add.reduceat(value, first)
            i = j
        return mix(out ^ (lengths.astype(np.uint64) * _PRIME))

    def place(self) -> np.ndarray:
        """Each run's number within its row, from 0."""
        return np.arange(len(self)) - np.repeat(np.cumsum(self.per_row) - self.per_row, self.per_row)


def run_hash(text: str, member: np.ndarray = NOT_SPACE, fold: np.ndarray = LOWER) -> list[int]:
    """The hashes of one text's runs, as `Runs.hashes` gives them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return Runs(raw, np.array([0, len(raw)]), member, fold).hashes().tolist()


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first run) of every n consecutive runs of the same row."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total += mix(hashes[k : k + size] + _PLACE[k])
    whole = row[:size] == row[n - 1 :]
    return mix(total[whole]), np.flatnonzero(whole)


def tagged(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row."""
    return mix(hashes + row.astype(np.uint64) * _PRIME)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of per-byte values for each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
