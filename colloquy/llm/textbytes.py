"""Words and word hashes of Arrow string columns, found with whole-array operations on their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # bytes of text worked on at once; a longer text is one slice

_FACTOR = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Truth table of the bytes in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# Words by white space: all bytes but \x20 and \x09-\x0D.
NON_SPACE = byte_class((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))
# Digits, letters (upper case is folded first) and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, stop
        row = stop


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the hash factor and of its inverse, kept for the process."""

    up = np.zeros(0, np.uint64)
    down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 1)
            cls.up, cls.down = (np.cumprod(np.full(size, f, np.uint64)) for f in (_FACTOR, _INVERSE))
        return cls.up, cls.down


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch of `data` follows; see `stretch_hash`."""
    up, _ = _Powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte stretches [start, stop)."""
    _, down = _Powers.get(len(sums))
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


@dataclass
class Words:
    """The words of some rows in order: byte ranges in `data`, row numbers, hashes; `first[r]` is the number of the
    first word of row r (one more entry than rows)."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    @property
    def hash(self) -> np.ndarray:
        return stretch_hash(self.sums, self.start, self.stop)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: np.ndarray) -> Words:
    """Words of the rows that `offsets` delimits in `data`: longest runs of bytes in `member`, after `fold`."""
    base = int(offsets[0])
    data = fold[data[base : int(offsets[-1])]]
    at = offsets - base
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    if len(data):
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[0], inside[-1]
    # A row border inside a run is both the end of a word and the start of another.
    inner = at[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    both = inner[inside[inner] & inside[inner - 1]]
    marks = np.flatnonzero(edge)
    if len(both):
        marks = np.sort(np.concatenate([marks, both, both]))
    start, stop = marks[0::2], marks[1::2]
    first = np.searchsorted(start, at)
    return Words(data, start, stop, first, prefix_sums(data))


def tokenized(column: pa.Array | pa.ChunkedArray, member: np.ndarray, fold: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for slices of the column."""
    data, offsets = text_buffers(column)
    for low, high in slices(offsets, limit):
        yield low, high, words(data, offsets[low : high + 1], member, fold)


def window_hash(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a row; a row of fewer words, but not none, has one run of them all.
    Returns the hashes and, for each row, the number of the first one (one more entry than rows)."""
    lengths = np.diff(first)
    whole = lengths >= size
    runs = np.where(whole, lengths - size + 1, (lengths > 0).astype(lengths.dtype))
    offsets = np.concatenate([[0], np.cumsum(runs)])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    sums = prefix_sums(np.zeros(0, np.uint8)) if not len(h) else _sums64(h)
    row = np.repeat(np.arange(len(runs)), runs)
    start = first[:-1][row] + np.arange(offsets[-1]) - offsets[row]
    stop = np.where(whole[row], start + size, first[1:][row])
    return stretch_hash(sums, start, stop), offsets


def _sums64(h: np.ndarray) -> np.ndarray:
    up, _ = _Powers.get(len(h) + 1)
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=out[1:])
    return out
