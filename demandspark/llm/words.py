"""Words of Arrow text columns in numpy: spans, counts by row, and 128-bit hashes.

Everything works on the UTF-8 bytes of a whole batch at once. Texts are cut nowhere: a chunk
holds whole rows, so one very long text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
PAD = 8

_bytes = np.arange(256)
#: Lower case for A-Z only.
LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)
#: Not white space: [^\x20\x09-\x0D]
NOT_SPACE = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: Letters, digits and all beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower case
ALNUM = (
    (_bytes >= 0x80) | ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A))
)

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)
#: Keeps the first n bytes of a little-endian lane.
_KEEP = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 9)], dtype=np.uint64)


@dataclass
class Chunk:
    """Rows first..last of a batch: their bytes (padded) and where each row starts."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return len(self.data) - PAD


@dataclass
class Words:
    """Spans of the words of a chunk, in order, and the number of the first word by row."""

    starts: np.ndarray
    ends: np.ndarray
    row_first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_first) - 1), self.counts)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, lower: bool = True, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column in runs of whole rows of about ``limit`` bytes."""
    data, offsets = column_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        part = data[offsets[first] : offsets[last]]
        out = np.zeros(len(part) + PAD, np.uint8)
        out[: len(part)] = LOWER[part] if lower else part
        yield Chunk(first, last, out, offsets[first : last + 1] - offsets[first])
        first = last


def slices(batch: pa.RecordBatch, text: int, limit: int = 2 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about ``limit`` bytes of its column ``text``."""
    _, offsets = column_bytes(batch.column(text))
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def words(chunk: Chunk, inside_table: np.ndarray) -> Words:
    """Maximal runs of the bytes that ``inside_table`` allows; none crosses a row's end."""
    n = chunk.size
    inside = inside_table[chunk.data[:n]]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[chunk.offsets[:-1][chunk.offsets[:-1] < n]] = False
    after[chunk.offsets[1:][chunk.offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, chunk.offsets))


def lanes(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every position, as one little-endian number; needs padded bytes."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)) if len(data) > 7 else np.zeros(0, "<u8")


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of padded bytes."""
    length = (ends - starts).astype(np.int64)
    lane = lanes(data)
    h = (length.astype(np.uint64) + np.uint64(seed)) * _M2
    active, at, left = slice(None), starts, length
    with np.errstate(over="ignore"):
        while True:
            k = lane[at] & _KEEP[np.minimum(left, 8)]
            v = (h[active] ^ k) * _M1
            v ^= v >> _S29
            h[active] = v * _M2 + k
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            active = more if isinstance(active, slice) else active[more]
            at, left = at[more] + 8, left[more] - 8
        h ^= h >> _S32
        h *= _M1
        h ^= h >> _S29
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each span of padded bytes, all spans side by side."""
    lane = lanes(data)
    length = (ends - starts).astype(np.int64)
    at, seed = starts.copy(), np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), seed + _P5)
        long = np.flatnonzero(length >= 32)
        if len(long):
            acc = [np.full(len(long), v) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            stripes, k = length[long] // 32, 0
            some = slice(None)
            while True:
                here = at[long][some] + 32 * k
                for i in range(4):
                    acc[i][some] = _round(acc[i][some], lane[here + 8 * i])
                k += 1
                more = np.flatnonzero(stripes > k)
                if not len(more):
                    break
                some = more
            mixed = _rotated(acc[0], 1) + _rotated(acc[1], 7) + _rotated(acc[2], 12) + _rotated(acc[3], 18)
            for v in acc:
                mixed = (mixed ^ _round(np.zeros_like(v), v)) * _P1 + _P4
            h[long] = mixed
            at[long] += 32 * stripes
        h += length.astype(np.uint64)
        left = length % 32
        for k in range(3):
            some = np.flatnonzero(left >= 8 * (k + 1))
            if not len(some):
                break
            v = h[some] ^ _round(np.zeros(len(some), np.uint64), lane[at[some]])
            h[some] = _rotated(v, 27) * _P1 + _P4
            at[some] += 8
        left &= 7
        some = np.flatnonzero(left >= 4)
        v = h[some] ^ ((lane[at[some]] & _KEEP[4]) * _P1)
        h[some] = _rotated(v, 23) * _P2 + _P3
        at[some] += 4
        left &= 3
        for k in range(3):
            some = np.flatnonzero(left > k)
            v = h[some] ^ (data[at[some]].astype(np.uint64) * _P5)
            h[some] = _rotated(v, 11) * _P1
            at[some] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> _S29
        h *= _P3
        h ^= h >> _S32
    return h
