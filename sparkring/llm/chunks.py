"""Encoding of texts by parts that a tokenizer never merges across, each distinct part encoded once.

A space between two characters that are not white space always begins a pre-token of the byte-level BPE pattern, so
the text may be cut there and the parts encoded alone; so does a line feed between such characters, which is a
pre-token of its own.  Texts with any other use of the two are handed over whole.
Parts are told apart by Arrow's dictionary encoding, and the ids of all texts are gathered from those of the distinct
parts in one step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_KEEP = 600_000
_LONG = 256
_STEP = 1 << 16
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARKS = ".,;:!?%*#$&\"()[]"


def _alone(part: str) -> bool:
    """Whether the spaces around a part stand alone; isspace() covers more characters than the pattern's, never fewer."""
    body = part[1:] if part[:1] == "\n" else part
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start:start + size] of the entries `which`, one after another, and where each begins."""
    begin = np.append(0, np.cumsum(size[which]))
    out = np.empty(begin[-1], dtype=flat.dtype)
    for i in range(0, len(which), _STEP):  # a cache's worth of places at a time
        own = which[i : i + _STEP]
        low, high = begin[i], begin[i + len(own)]
        at = np.repeat(start[own] - (begin[i : i + len(own)] - low), size[own])
        at += np.arange(high - low)
        out[low:high] = flat[at]
    return out, begin


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (64-bit) and bytes of a string array without nulls."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _strings(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    data, at = gather(flat, start, size, np.arange(len(start)))
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(data))


def _cores(parts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each part as a core and the marks at its end, which are a pre-token of their own after a letter or number."""
    cores = pc.utf8_rtrim(parts, _MARKS)
    at, flat = _bytes(parts)
    size = np.diff(_bytes(cores)[0])
    whole = np.diff(at)
    last = flat[np.maximum(at[:-1] + size - 1, 0)] if len(flat) else np.zeros(len(size), np.uint8)
    marked = (size < whole) & (size > 0)
    for k in np.flatnonzero(marked & (last >= 0x80)).tolist():
        marked[k] = cores[k].as_py()[-1].isalnum()
    marked &= (last >= 0x80) | _ALNUM[last]
    size = np.where(marked, size, whole)
    return _strings(flat, at[:-1], size), _strings(flat, at[:-1] + size, whole - size)


def runs(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids in bytes, one after another, and how many each has."""
    return np.frombuffer(b"".join(coded), dtype="<u4"), np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4


def _split(strings: pa.Array) -> list[str]:
    """Strings without spaces as Python's."""
    at, flat = _bytes(strings)
    return np.insert(flat[at[0] : at[-1]], at[1:-1] - at[0], 32).tobytes().decode().split(" ") if len(strings) else []


class Runs(NamedTuple):
    """flat[start:start + size] are the ids of each; the first one is empty."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def more(self, flat: np.ndarray, size: np.ndarray) -> Runs:
        start = len(self.flat) + np.cumsum(size) - size
        return Runs(np.append(self.flat, flat), np.append(self.start, start), np.append(self.size, size))


_NONE = Runs(np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64))


class ChunkEncoder:
    """Keeps the ids of short parts, within bounds.

    `whole` encodes each of some texts; `spaced` gives the runs of distinct parts, each with a space or line feed at its begin alone.
    """

    def __init__(self, whole: Callable[[list[str]], list[bytes]], spaced: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int = _KEEP):
        self.whole, self.spaced, self.keep = whole, spaced, keep
        self.known: dict[str, int] = {}  # which of the runs; 0: the text needs to be encoded whole
        self.runs = _NONE

    def _look(self, parts: list[str]) -> tuple[np.ndarray, Runs]:
        """Which of the runs each of the distinct parts has, 0 as above; runs of long parts are only in those returned."""
        found = np.fromiter(map(self.known.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        at = np.flatnonzero(found < 0).tolist()
        if len(self.known) + len(at) > self.keep:  # what is in use again stays
            used = np.flatnonzero(found >= 0)
            flat, begin = gather(*self.runs, found[used])
            self.runs = _NONE.more(flat, np.diff(begin))
            found[used] = np.where(found[used] > 0, np.arange(1, len(used) + 1), 0)
            self.known = dict(zip(map(parts.__getitem__, used.tolist()), found[used].tolist(), strict=True))
        held = self.runs
        for new in ([k for k in at if len(parts[k]) <= _LONG], [k for k in at if len(parts[k]) > _LONG]):
            if not new:
                continue
            good = np.fromiter((_alone(parts[k]) for k in new), dtype=bool, count=len(new))
            own = np.where(good, np.cumsum(good) + len(held.start) - 1, 0)
            texts = [x if x[0] == "\n" else " " + x for x in (parts[k] for k, ok in zip(new, good.tolist(), strict=True) if ok)]
            if texts:
                held = held.more(*self.spaced(texts))
            found[new] = own
            if len(parts[new[0]]) <= _LONG:
                self.known.update(zip(map(parts.__getitem__, new), own.tolist(), strict=True))
                self.runs = held
        return found, held

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin; null counts as empty."""
        texts = texts.fill_null("")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        first = split.offsets.to_numpy().astype(np.int64)
        first -= first[0]
        coded = split.flatten().dictionary_encode()
        which, distinct = coded.indices.to_numpy().copy(), coded.dictionary
        del split, coded
        cores, marks = (x.dictionary_encode() for x in _cores(distinct))
        core, mark = (x.indices.to_numpy() for x in (cores, marks))
        found, held = self._look(_split(cores.dictionary))
        # A text is cut if its parts allow it; its first part has no space before it and is encoded on its own.
        unsafe = np.logical_or.reduceat((found == 0)[core][which], first[:-1]) & (np.diff(first) > 1)
        use = np.repeat(~unsafe, np.diff(first))
        use[first[:-1]] = True
        heads = distinct.take(pa.array(which[first[:-1]])).to_pylist()
        for k in np.flatnonzero(unsafe).tolist():
            heads[k] = texts[k].as_py()
        # Runs to gather: the cores, the marks and the heads; two for each part.
        n = len(held.start)
        held = held.more(*runs(self.whole(marks.dictionary.to_pylist()) + self.whole(heads)))
        pairs = np.empty((len(which), 2), dtype=np.int32)
        pairs[:, 0], pairs[:, 1] = found.astype(np.int32)[core][which], (mark + n)[which]
        pairs[first[:-1], 0] = n + len(marks.dictionary) + np.arange(len(texts))
        pairs[first[:-1], 1] = 0
        ids, begin = gather(*held, pairs[use].reshape(-1))
        return ids, begin[2 * np.append(0, np.cumsum(use))[first]]


def groups(texts: pa.Array, size: int = 4_000_000) -> Iterator[slice]:
    """Runs of texts with about so many bytes together."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + size)) + 1
        end = min(max(end, begin + 1), len(texts))
        yield slice(begin, end)
        begin = end
