"""Vectorised word and word-window hashing over Arrow string columns.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return
(``[^\\x20\\x09-\\x0D]+``).  Words are hashed eight bytes at a time, each step mixed, so that no arithmetic structure of
a word survives; words of more than 64 bytes by XXH3.  Windows of words are hashed by doubling: a window's hash is made of
those of its two halves, in order and mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers and salts of the hashes; the second of each serves windows' second hash.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WINDOW_STEPS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_SECOND = np.uint64(0xE7037ED1A0B428DB)
#: Words of more bytes than this are hashed one by one.
_LONG_WORD = 64
_CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
_MARKS = np.arange(256) < 128
_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For a number of bytes up to 8, the mask that keeps so many.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of consecutive documents: hash per word, and each document's first word (one more entry than documents)."""

    first: np.ndarray
    hash: np.ndarray
    start: np.ndarray  # byte positions within the batch
    end: np.ndarray
    data: np.ndarray  # the bytes themselves
    rows: slice  # the documents' rows in the column
    bounds: np.ndarray  # byte positions of the documents, one more than documents

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def split(column: pa.Array, lower: bool = False, marks: bool = True) -> Iterator[Words]:
    """The words of a column of texts, a few documents (about half a megabyte) at a time; null counts as empty.

    Without `marks`, ASCII characters other than letters and digits part words as white space does.
    """
    if not len(column):
        return
    pa.default_memory_pool().release_unused()
    at, raw = _string_buffers(column)
    row = 0
    while row < len(at) - 1:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + _CHUNK_BYTES, side="right")) - 1)
        stop = min(stop, len(at) - 1)
        yield _split(raw[at[row] : at[stop]], at[row : stop + 1] - at[row], lower, slice(row, stop), _SPACE if marks else _MARKS)
        row = stop


def _split(data: np.ndarray, at: np.ndarray, lower: bool, rows: slice, between: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(at), np.int64), none.astype(np.uint64), none, none, data, rows, at)
    if lower:
        data = _LOWER[data]
    inside = ~between[data]
    edge = np.zeros(n + 1, dtype=bool)  # document boundaries
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(np.searchsorted(start, at), _hashed(data, start, end), start, end, data, rows, at)


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    value = size.astype(np.uint64) * _STEP
    rows, at, left = np.arange(len(size)), start, size
    long = size > _LONG_WORD
    if long.any():
        rows = np.flatnonzero(~long)
        at, left = start[rows], size[rows]
    while len(rows):
        lane = eight[at] & _KEPT[np.minimum(left, 8)]
        value[rows] = mix(value[rows] * _STEP + lane)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    if long.any():
        raw = memoryview(padded)
        for k in np.flatnonzero(long).tolist():
            value[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
    return value


def _paired(left: np.ndarray, right: np.ndarray, step: np.uint64) -> np.ndarray:
    """Hashes of pairs, in order."""
    out = left * step
    out += right
    out ^= out >> np.uint64(29)
    out *= _STEP
    out ^= out >> np.uint64(32)
    return out


def windows(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of `size` consecutive word hashes (across documents too: mask with `window_mask`)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = _WINDOW_STEPS[which]
    part = mix(words ^ _SECOND) if which else words
    done, out, have = 0, None, 1  # `part`: hashes of `have` words; `out`: of the first `done` words of each window
    while True:
        if size & have:
            out = part[:n] if out is None else _paired(out, part[done : done + n], step)
            done += have
        if done == size:
            return mix(out + np.uint64(size))
        part = _paired(part[:-have], part[have:], step)
        have *= 2


def window_mask(first: np.ndarray, size: int) -> np.ndarray:
    """Which windows lie within one document."""
    n = int(first[-1]) - size + 1
    ok = np.zeros(max(n, 0), dtype=np.int32)
    if n <= 0:
        return ok.astype(bool)
    step = np.zeros(n + 1, dtype=np.int32)
    begin, stop = first[:-1], first[1:] - size + 1
    has = stop > begin
    np.add.at(step, begin[has], 1)
    np.add.at(step, stop[has], -1)
    return np.cumsum(step[:-1]) > 0
