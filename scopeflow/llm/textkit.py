"""Columnar text primitives on Arrow string buffers.

Every function works on the UTF-8 bytes of a whole batch at once. A word is a maximal run of bytes outside
``\\x20\\x09-\\x0D`` within one document; that byte rule equals the code point rule since all six separators are ASCII.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Longer ranges are hashed one by one by a library.
LONG = 4096
#: The first k bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Byte classes. Separators of words; A-Z to a-z.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: At most so many bytes of text are turned into arrays at a time (a longer document makes a slice of its own).
SLICE_BYTES = 1 << 20


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and at its end what the allocators hold goes back to the system: a worker waits for its next task with little memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finalizer of splitmix64)."""
    y = x >> U64(30)
    y ^= x
    y *= U64(0xBF58476D1CE4E5B9)
    y ^= y >> U64(27)
    y *= U64(0x94D049BB133111EB)
    y ^= y >> U64(31)
    return y


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column as one large_string array, null turned into the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in them) of consecutive rows of up to ``limit`` bytes, one row at least."""
    limit = limit or SLICE_BYTES
    column = text_column(column)
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


@dataclass
class Words:
    """Words of some documents: byte ranges, the row of each, and where each row's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of row i

    def __len__(self) -> int:
        return len(self.start)


def words_of(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> Words:
    """Maximal runs of bytes that are no ``separator`` (a flag for each byte) within each row."""
    n_rows = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(n_rows + 1, np.int64))
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    return Words(data, start, end, row, first)


def words64(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a little-endian word, zeros beyond the end; one place more than there are bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever the range lies: a chain of mixed words of 8 bytes, begun with the length."""
    left = end - start
    h = mix64(left.astype(U64) * U64(0xD1342543DE82EF95) + U64(0x9E3779B97F4A7C15))
    words = words64(data)
    whole = left > LONG
    which, at, left = slice(None), start, np.where(whole, 0, left)
    while len(at):
        h[which] = mix64(h[which] ^ (words[at] & _FIRST[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        which = more if isinstance(which, slice) else which[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(whole).tolist():
        h[i] = int.from_bytes(blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def equal_ranges(data: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``size`` bytes at ``one`` and at ``two`` hold the same bytes, pair by pair."""
    same, words = np.ones(len(one), bool), words64(data)
    which = np.flatnonzero(size > 0)
    at = 0
    while len(which):
        keep = _FIRST[np.minimum(size[which] - at, 8)]
        same[which] &= (words[one[which] + at] & keep) == (words[two[which] + at] & keep)
        at += 8
        which = which[(size[which] > at) & same[which]]
    return same


def equal_classes(data: np.ndarray, start: np.ndarray, size: np.ndarray, order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each range, the first range of each class by ``order_by``): ranges of one class hold the same bytes. Hashes propose, bytes decide."""
    h = range_hashes(data, start, start + size)
    order = np.lexsort((order_by, h))
    new = np.ones(len(order), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # of each range's class
    wrong = (size[order] != size[head]) | ~equal_ranges(data, start[order], start[head], np.minimum(size[order], size[head]))
    which = np.cumsum(new) - 1
    first = order[new]
    extra: dict[bytes, int] = {}
    for k in np.flatnonzero(wrong).tolist():  # two texts of one hash
        i = order[k]
        text = data[start[i] : start[i] + size[i]].tobytes()
        if text not in extra:
            extra[text] = len(first)
            first = np.append(first, i)
        which[k] = extra[text]
    out = np.empty(len(order), np.int64)
    out[order] = which
    return out, first


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every run of ``size`` words of a row; the whole of a shorter, non-empty row is its only one."""
    n = len(words)
    counts = np.diff(words.first)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none
    factors = mix64(np.arange(1, size + 1, dtype=U64)) | U64(1)
    last = words.first[words.row + 1]
    at = np.flatnonzero(np.arange(n) + size <= last)
    h = np.zeros(len(at), U64)
    for j in range(size):
        h += mix64(hashes[at + j] + factors[j]) * factors[j]
    h = mix64(h)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        hs = np.zeros(len(short), U64)
        for j in range(size - 1):
            has = counts[short] > j
            at_j = words.first[short[has]] + j
            hs[has] += mix64(hashes[at_j] + factors[j]) * factors[j]
        hs = mix64(hs ^ (counts[short].astype(U64) << U64(32)))
        at_all = np.concatenate([at, words.first[short]])
        order = np.argsort(at_all, kind="stable")
        at, h = at_all[order], np.concatenate([h, hs])[order]
    return h, words.row[at], at


def lowered(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def large_strings(values: list) -> pa.Array:
    return pa.array(values, pa.large_string())
