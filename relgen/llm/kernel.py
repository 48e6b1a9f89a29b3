"""Vectorised text kernel: words, and 64-bit hashes of runs of bytes and of spans of words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Arrow string columns are read
through their buffers, so a whole batch is processed by a handful of numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one numpy pass; bounds the kernel's memory (single longer texts pass whole).
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first n bytes of a little-endian piece of eight.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; ``salt`` selects one of many independent functions."""
    x = x ^ np.uint64((salt * 0xA0761D6478BD642F + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def bytes_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each run of bytes [start, end): its pieces of eight bytes, each mixed with its place, are summed and mixed.

    No term is linear in the bytes, so repetitive texts, on which polynomials modulo 2**64 fail, are told apart.
    """
    size = end - start
    pieces = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    take = lambda at, n: pieces[at].view("<u8").ravel() & _MASK[np.minimum(n, 8)]
    h = mix(take(start, size), salt * 4 + 400)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        owner, j = np.repeat(long, more), ranges(np.ones(len(long), np.int64), more)
        rest = mix(take(start[owner] + 8 * j, size[owner] - 8 * j) ^ mix(j.astype(np.uint64), 17), salt * 4 + 401)
        h[long] += np.add.reduceat(rest, np.append(0, np.cumsum(more)[:-1]))
    return mix(h + size.astype(np.uint64), salt * 4 + 402)


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each non-empty span [start, end) of values, wherever it lies.

    Hashes of 1, 2, 4 .. values come from those of their halves; a span's comes from its first and last so
    many values, the greatest power of two that fits, which cover it.
    """
    size = end - start
    out = np.zeros(len(size), np.uint64)
    if not len(size):
        return out
    level = np.frexp(size.astype(np.float64))[1] - 1
    part, width = mix(values, salt * 4 + 800), 1
    same = level.min() == level.max()
    for i in range(int(level.max()) + 1):
        at = slice(None) if same else np.flatnonzero(level == i)
        if not same or i == level[0]:
            out[at] = mix(part[start[at]] * _ODD + part[end[at] - width], salt * 4 + 801)
        if i < level.max():
            part = mix(part[:-width] * _ODD + part[width:], salt * 4 + 802)
            width *= 2
    return mix(out + size.astype(np.uint64), salt * 4 + 803)


@dataclass
class Words:
    """Words of some texts; those of text i are ``off[i]:off[i + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.off)


def words_of(data: np.ndarray, text_off: np.ndarray, lower: bool = False) -> Words:
    """``data``: the texts' bytes; ``text_off``: where each begins, and the end of the last."""
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    n = len(data)
    begins = text_off[:-1][text_off[:-1] < n]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[begins] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[begins[begins > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, text_off), bytes_hash(data, start, end))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty texts."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    if off[-1] == off[0] or values is None:
        return np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    return np.frombuffer(values, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about ``most`` bytes of text: (rows, bytes, offsets)."""
    data, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions start[i] .. start[i] + count[i] - 1, one run after the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def signed(x: np.ndarray) -> pa.Array:
    """uint64 as Spark's bigint."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
