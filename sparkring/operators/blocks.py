"""Products block against block: rows of A and columns of B are cut into ranges, packed, and met in numpy.

A join makes a row for each pair of edges that share a vertex; here no such pair leaves its task.  What is shuffled are the packed
edges, once, so that each range lies there in one piece: a range of A's rows meets each range of B's columns with which it has places
to fill.  For a graph whose neighbours have near ids these are few, and are shuffled if that sends no more than lies there already;
else, as for one without any order (the square of the edges), tasks read both ranges where they lie, and nothing is sent.

Masked products cut the vertices between A and B as well: a task holds the places of two ranges, and A's and B's blocks pass it one
after another.  So only blocks, not whole rows of them, must fit a task; without any order there are then as many ranges as the root
of the edges, and what is sent grows as their power 1.5.  It goes in waves, one job after another, so that what lies on disk at once
grows with the edges only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import prep

#: Edges of a range; ranges at least, if each then has so many edges.
TARGET, LEAST, SMALL = 1_500_000, 8, 20_000
#: Ranges of the vertices between two sides, so that few ranges of rows and columns meet that share none of them: so many for each range, or FINE.
FINER, FINE = 8, 512
#: What a wave of a masked product sends, in times the bytes of its packed edges; ranges between A and B that one task of a sum walks.
WAVE, SPAN = 1.0, 3
#: What a whole product may shuffle, in times its packed edges.  Else tasks read the ranges: parts of each side at most, if each has so
#: many edges; ranges of a part at most.
SENT, PARTS, PART, HELD = 1.0, 64, 200_000, 16
#: Edges sorted at once when they are packed; cells of a dense block of rows; walked entries at once; rows of a batch that is returned.
PACKED, CELLS, WALKED, BATCH = 2_000_000, 1 << 22, 1 << 20, 1 << 17
#: Bits of a word where edges count once and no width is asked for.
WORD = 64
#: Ids that lie within so many are looked up in a table.
NEAR = 1 << 23
_CHUNKS = "blk long, across array<long>, n long, body binary"
Kernel = Callable[..., Iterator[list[np.ndarray]]]


# Packed edges


def _sorted(line: np.ndarray, other: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """The rows in order of line, then other."""
    if not len(line):
        return [line, other, *more]
    low, least = line.min(), other.min()
    span = int(other.max()) - int(least) + 1
    if (int(line.max()) - int(low) + 1) * span < 1 << 62:
        key = (line - low) * span + (other - least)
        if not more:
            key.sort()
            first, second = np.divmod(key, span)
            return [first + low, second + least]
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort((other, line))
    return [x[order] for x in (line, other, *more)]


def _narrow(x: np.ndarray) -> bytes:
    """Not negative integers in as few bytes as the largest needs, byte by byte of all, compressed."""
    kind = np.min_scalar_type(int(x.max()))
    planes = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T)
    body = pa.compress(planes.tobytes(), "zstd", asbytes=True)
    return np.array([kind.itemsize, len(body)], dtype="<i8").tobytes() + body


def dump(line: np.ndarray, other: np.ndarray, value: np.ndarray | None) -> bytes:
    """Sorted edges, with values if there are any."""
    head = np.array([len(line), line[0], other.min(), value is not None], dtype="<i8").tobytes()
    body = head + _narrow(np.diff(line, prepend=line[0]).view(np.uint64)) + _narrow((other - other.min()).view(np.uint64))
    return body if value is None else body + pa.compress(value.astype("<f8").tobytes(), "zstd", asbytes=True)


def parse(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    n, first, least, valued = (int(x) for x in np.frombuffer(raw, "<i8", 4))
    at, out = 32, []
    for _ in range(2):
        size, length = (int(x) for x in np.frombuffer(raw, "<i8", 2, at))
        planes = np.frombuffer(pa.decompress(raw[at + 16 : at + 16 + length], n * size, "zstd", asbytes=True), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(size, n).T).view(f"<u{size}").ravel().astype(np.int64))
        at += 16 + length
    value = np.frombuffer(pa.decompress(raw[at:], n * 8, "zstd", asbytes=True), "<f8") if valued else None
    return np.cumsum(out[0]) + first, out[1] + least, value


def _pack(cuts: np.ndarray, across: np.ndarray, valued: bool, square: bool):
    """Edges (line, other[, value]) as bodies by the range of line, or with `square` by the ranges of both."""

    def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        names, over, sizes, bodies = [], [], [], []
        parts = [slice(None)]
        if square:
            where = np.searchsorted(across, columns[1], "right")
            parts = np.split(np.argsort(where, kind="stable"), np.flatnonzero(np.diff(np.sort(where))) + 1)
        for part in parts:
            rows = _sorted(*(x[part] for x in columns))
            ends = np.searchsorted(rows[0], cuts, "left")
            for blk, (a, b) in enumerate(zip([0, *ends], [*ends, len(rows[0])], strict=True)):
                if a < b:
                    names.append(blk)
                    over.append(np.unique(np.searchsorted(across, rows[1][a : a + 1 if square else b], "right")).tolist() if len(across) else [0])
                    sizes.append(int(b - a))
                    bodies.append(dump(rows[0][a:b], rows[1][a:b], rows[2][a:b] if valued else None))
        columns = [pa.array(names, pa.int64()), pa.array(over, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["blk", "across", "n", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                n += batch.num_rows
            if n >= PACKED:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return run


# Blocks


class Lines:
    """Sorted lines of a matrix in compressed form: names, start (one more than names), other, value (None: all 1)."""

    def __init__(self, line: np.ndarray, other: np.ndarray, value: np.ndarray | None):
        new = np.flatnonzero(np.diff(line, prepend=line[:1] - 1)) if len(line) else np.zeros(0, np.int64)
        self.names, self.start = line[new], np.append(new, len(line))
        self.other, self.value = other, value

    @property
    def length(self) -> np.ndarray:
        return np.diff(self.start)

    @property
    def line(self) -> np.ndarray:
        return np.repeat(self.names, self.length)


def _joined(bodies: list[bytes]) -> list[np.ndarray]:
    """The sorted edges of all bodies, with values if any has them."""
    parts = [parse(x) for x in bodies]
    valued = any(p[2] is not None for p in parts)
    if len(parts) == 1:
        return list(parts[0][: 3 if valued else 2])
    return _sorted(*(np.concatenate([p[k] for p in parts]) for k in range(3 if valued else 2)))


def _lines(bodies: list[bytes], packed: int, once: bool) -> Lines:
    """Repeated edges become one, with their sum unless each counts once; with a width, edges become words of bits (others are
    blocks then)."""
    rows = _joined(bodies)
    valued = len(rows) == 3
    line, other = rows[:2]
    value = rows[2] if valued else None
    if packed:
        value = np.left_shift(np.uint64(1), (packed - 1 - other % packed).astype(np.uint64)).astype(f"u{max(1, packed // 8)}")
        other = other // packed
    new = np.flatnonzero((np.diff(line, prepend=line[:1] - 1) != 0) | (np.diff(other, prepend=other[:1] - 1) != 0))
    if packed:
        value = np.bitwise_or.reduceat(value, new)
    elif once:
        value = None if value is None else value[new]
    elif len(new) < len(line):
        value = np.diff(np.append(new, len(line))) if value is None else np.add.reduceat(value, new)
    return Lines(line[new], other[new], value)


def _common(a: Lines, b: Lines) -> tuple[Lines, Lines, np.ndarray]:
    """Both sides with others renumbered by those that both have, without the rest; and which these are."""
    low, high = max(a.other.min(), b.other.min()), min(a.other.max(), b.other.max())
    near = 0 <= int(high) - int(low) < NEAR
    if near:
        seen = [np.zeros(high - low + 1, bool) for _ in range(2)]
        for x, s in zip((a, b), seen, strict=True):
            s[x.other[(x.other >= low) & (x.other <= high)] - low] = True
        both = seen[0] & seen[1]
        shared, place = np.flatnonzero(both) + low, np.cumsum(both) - 1
    else:
        shared = np.intersect1d(a.other, b.other)
    out = []
    for x in (a, b):
        if near:
            keep = np.flatnonzero((x.other >= low) & (x.other <= high))
            keep = keep[both[x.other[keep] - low]]
            at = place[x.other[keep] - low]
        else:
            at = np.searchsorted(shared, x.other)
            keep = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == x.other) if len(shared) else at[:0]
            at = at[keep]
        out.append(Lines(x.line[keep], at, None if x.value is None else x.value[keep]))
    return *out, shared


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and each one's place among them."""
    low, high = ids.min(), ids.max()
    if int(high) - int(low) >= NEAR:
        return np.unique(ids, return_inverse=True)
    seen = np.zeros(high - low + 1, bool)
    seen[ids - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[ids - low]


def _index(names: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where ids are among the sorted names; -1: nowhere."""
    at = np.minimum(np.searchsorted(names, ids), len(names) - 1)
    return np.where(names[at] == ids, at, -1)


class Places:
    """Rows and columns of the mask, how often each place is in it, and what was summed at it so far."""

    def __init__(self, line: np.ndarray, other: np.ndarray, often: np.ndarray):
        self.line, self.other, self.often = line, other, often
        (self.rows, self.row), (self.cols, self.col) = _numbered(line), _numbered(other)
        self.total = np.zeros(len(line), np.int64)


def _places(bodies: list[bytes], once: bool) -> Places:
    x = _lines(bodies, 0, once)
    return Places(x.line, x.other, np.ones(len(x.other), np.int64) if x.value is None else x.value)


def _expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after another."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _cut(row: np.ndarray, work: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Runs of entries, sorted by row, over so many rows at most and some WALKED units of work."""
    done, at = np.cumsum(work), 0
    while at < len(row):
        end = min(np.searchsorted(row, row[at] + rows), np.searchsorted(done, (done[at - 1] if at else 0) + WALKED, "right"))
        yield at, (at := max(int(end), at + 1))


def _walk(flagged: Lines, walked: Lines, width: int, f: np.ndarray, g: np.ndarray, packed: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For places (line f of one side, line g of the other), in order of f: a run of places, the walked entries' products, the
    places' first entries, and what was walked."""
    if not len(f):
        return
    length, rows = walked.length, min(max(1, CELLS // width), int(f[-1] - f[0]) + 1)
    dense = np.zeros(rows * width, np.uint8 if flagged.value is None else flagged.value.dtype)
    for a, b in _cut(f, length[g], rows):
        low, high = f[a], f[b - 1] + 1
        own = slice(flagged.start[low], flagged.start[high])
        cell = np.repeat(np.arange(high - low), flagged.length[low:high]) * width + flagged.other[own]
        dense[cell] = 1 if flagged.value is None else flagged.value[own]
        n = length[g[a:b]]
        at = _expand(walked.start[g[a:b]], n)
        got = dense[np.repeat((f[a:b] - low) * width, n) + walked.other[at]]
        dense[cell] = 0
        if packed:
            got = np.bitwise_count(got & walked.value[at])
        elif walked.value is not None:
            got = got * walked.value[at]
        yield slice(a, b), got, np.cumsum(n) - n, at


def _masked(a: Lines, b: Lines, places: Places, packed: int) -> Iterator[tuple]:
    """Products at places: each walks along the shorter one of A's row and B's column and looks up the other.

    Gives flagged and walked side, the places, their lines on both and how often they are wanted, products, the places' first
    products, and the others walked along.
    """
    if not len(a.names) or not len(b.names):
        return
    width = int(max(a.other.max(), b.other.max())) + 1
    i, k = _index(a.names, places.rows)[places.row], _index(b.names, places.cols)[places.col]
    found = np.flatnonzero((i >= 0) & (k >= 0))
    i, k = i[found], k[found]
    by_col = b.length[k] <= a.length[i]
    for flagged, walked, f, g, own in ((a, b, i, k, by_col), (b, a, k, i, ~by_col)):
        f, g, place = f[own], g[own], found[own]
        order = np.argsort(f, kind="stable")
        f, g, place = f[order], g[order], place[order]
        for part, got, first, at in _walk(flagged, walked, width, f, g, packed):
            yield flagged, walked, place[part], f[part], g[part], places.often[place[part]], got, first, walked.other[at]


def _counts(packed: int) -> Kernel:
    """Adds to the places' totals, which `_counted` gives in the end."""

    def run(a: Lines, b: Lines, places: Places) -> Iterator[list[np.ndarray]]:
        a, b, _ = _common(a, b)
        for *_, place, _, _, often, got, first, _ in _masked(a, b, places, packed):
            places.total[place] += np.add.reduceat(got, first, dtype=np.int64) * often
        yield from ()

    return run


def _counted(places: Places) -> Iterator[list[np.ndarray]]:
    keep = places.total != 0
    yield [places.line[keep], places.other[keep], places.total[keep]]


def _totals(packed: int) -> Kernel:
    def run(a: Lines, b: Lines, places: Places) -> Iterator[list[np.ndarray]]:
        a, b, _ = _common(a, b)
        total = 0
        for *_, often, got, first, _ in _masked(a, b, places, packed):
            once = often.max() == 1
            total += int(got.sum(dtype=np.int64) if once else (np.add.reduceat(got, first, dtype=np.int64) * often).sum())
        yield [np.array([total])]

    return run


def _corners(a: Lines, b: Lines, places: Places) -> Iterator[list[np.ndarray]]:
    a, b, shared = _common(a, b)
    inner, ends = np.zeros(len(shared), np.int64), []
    for flagged, walked, _, f, g, often, got, first, other in _masked(a, b, places, 0):
        n = np.add.reduceat(got, first, dtype=np.int64) * often
        terms = got if often.max() == 1 else got * np.repeat(often, np.diff(np.append(first, len(got))))
        hit = np.flatnonzero(terms)
        inner += np.bincount(other[hit], terms[hit], minlength=len(inner)).astype(np.int64)
        for side, x in ((flagged, f), (walked, g)):
            summed = np.bincount(x - x.min(), n).astype(np.int64)
            hit = np.flatnonzero(summed)
            ends.append((side.names[hit + x.min()], summed[hit]))
    v, n = (np.concatenate(x) for x in zip((shared, inner), *ends, strict=True))
    names, at = np.unique(v, return_inverse=True)
    n = np.bincount(at, n, minlength=len(names)).astype(np.int64)
    yield [names[n > 0], n[n > 0]]


def _product(kind: str) -> Kernel:
    """All entries of the block: rows of A one after another, each entry adding B's row to a dense row; where these would stay nearly
    empty, entries are sorted instead."""

    def run(a: Lines, b: Lines, places) -> Iterator[list[np.ndarray]]:
        a, b, shared = _common(a, b)
        if not len(shared):
            return
        width = len(b.names)
        rows = max(1, (8 if kind == "bool" else 1) * CELLS // width)
        order = np.argsort(b.other, kind="stable")
        start = np.searchsorted(b.other[order], np.arange(len(shared) + 1))
        to, value = np.repeat(np.arange(width), b.length)[order], None if b.value is None else b.value[order]
        length = np.diff(start)
        row, work = np.repeat(np.arange(len(a.names)), a.length), length[a.other]
        number = np.float64 if kind == "weighted" else np.int64
        weighed = kind != "bool" and not (a.value is None and value is None)

        def met_by(low: int, part: slice) -> tuple[np.ndarray, np.ndarray | None]:
            j = a.other[part]
            at = _expand(start[j], length[j])
            weight = None
            if weighed:
                weight = np.ones(len(at)) if a.value is None else np.repeat(a.value[part], length[j])
                weight = weight if value is None else weight * value[at]
            return np.repeat((row[part] - low) * width, length[j]) + to[at], weight

        done, low = np.cumsum(np.add.reduceat(work, a.start[:-1])), 0
        while low < len(a.names):
            few = int(np.searchsorted(done, (done[low - 1] if low else 0) + WALKED, "right")) - low
            n = min(max(few, rows), len(a.names) - low)
            own = slice(a.start[low], a.start[low + n])
            if few > rows:  # more than CELLS for less than WALKED
                cell, weight = met_by(low, own)
                if weight is None:
                    cell.sort()
                else:
                    order = np.argsort(cell, kind="stable")
                    cell, weight = cell[order], weight[order]
                new = np.flatnonzero(np.diff(cell, prepend=-1))
                hit = cell[new]
                val = None if kind == "bool" else np.diff(np.append(new, len(cell))) if weight is None else np.add.reduceat(weight, new)
                val = val if val is None else val.astype(number, copy=False)
                i = hit // width
            else:
                cuts = list(_cut(row[own], work[own], rows))
                dense = np.zeros(n * width, bool) if kind == "bool" else None
                met = np.zeros(n * width, bool) if weighed else None
                for s, e in cuts:
                    part = slice(own.start + s, own.start + e)
                    cell, weight = met_by(low, part)
                    if kind == "bool":
                        dense[cell] = True
                        continue
                    if weighed:
                        met[cell] = True
                    if len(cuts) == 1:
                        dense = np.bincount(cell, weight, minlength=n * width).astype(number, copy=False)
                        continue
                    dense = np.zeros(n * width, number) if dense is None else dense
                    first = int(row[part.start] - low) * width
                    some = np.bincount(cell - first, weight).astype(number, copy=False)
                    dense[first : first + len(some)] += some
                hit = np.flatnonzero(met if weighed else dense)
                i = np.repeat(np.arange(n), np.diff(np.searchsorted(hit, np.arange(n + 1) * width)))
                val = None if kind == "bool" else dense[hit]
            yield [a.names[i + low], b.names[hit - i * width]] + ([] if val is None else [val])
            low += n

    return run


def _sizes(cuts: list[int]) -> Kernel:
    """(line, slot, word, n): how many entries each line of the block has.  Those in a slot of WORD columns in which another range
    begins come as a word of bits."""
    of, begun = _product("bool"), np.unique([x // WORD for x in cuts if x % WORD])

    def run(a: Lines, b: Lines, places) -> Iterator[list[np.ndarray]]:
        for line, other in of(a, b, places):
            slot = other // WORD
            border = np.isin(slot, begun)
            names, n = np.unique(line[~border], return_counts=True)
            yield [names, np.zeros_like(names), np.zeros_like(names), n]
            line, other, slot = line[border], other[border], slot[border]
            if len(line):
                new = np.flatnonzero((np.diff(line, prepend=line[0] - 1) != 0) | (np.diff(slot, prepend=slot[0] - 1) != 0))
                bits = np.left_shift(np.uint64(1), (WORD - 1 - other % WORD).astype(np.uint64))
                yield [line[new], slot[new], np.bitwise_or.reduceat(bits, new).view(np.int64), np.zeros(len(new), np.int64)]

    return run


# Plans


def _packed(edges: DataFrame, line: str, cuts: list[int], across: list[int], valued: bool = False, square: bool = False) -> DataFrame:
    other = "dst" if line == "src" else "src"
    columns = [F.col(line).cast("long"), F.col(other).cast("long")] + ([F.col("weight").cast("double")] if valued else [])
    return edges.where("src is not null and dst is not null").select(*columns).mapInArrow(_pack(np.array(cuts, np.int64), np.array(across, np.int64), valued, square), _CHUNKS)


def _merge(across: np.ndarray, once: bool):
    """Bodies (blk, body) in order of blk -> one body for each blk; once: without repeated edges."""

    def merged(blk: int, bodies: list[bytes]) -> pa.RecordBatch:
        rows = _joined(bodies)
        if once:
            new = (np.diff(rows[0], prepend=rows[0][0] - 1) != 0) | (np.diff(rows[1], prepend=rows[1][0] - 1) != 0)
            rows = [x[new] for x in rows]
        over = np.unique(np.searchsorted(across, rows[1], "right")).tolist() if len(across) else [0]
        body = dump(rows[0], rows[1], rows[2] if len(rows) == 3 else None)
        columns = [pa.array([blk], pa.int64()), pa.array([over], pa.list_(pa.int64())), pa.array([len(rows[0])], pa.int64()), pa.array([body], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["blk", "across", "n", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bodies = None, []
        for batch in batches:
            for blk, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bodies and blk != now:
                    yield merged(now, bodies)
                    bodies = []
                now = blk
                bodies.append(body.as_py())
        if bodies:
            yield merged(now, bodies)

    return run


def _side(work: Workspace, edges: DataFrame, name: str, line: str, cuts: list[int], across: list[int], once: bool, valued: bool = False) -> DataFrame:
    """One body for each range of line."""
    bodies = _packed(edges, line, cuts, [], valued).select("blk", "body").repartition(len(cuts) + 1, "blk").sortWithinPartitions("blk")
    return work.put(bodies.mapInArrow(_merge(np.array(across, np.int64), once), _CHUNKS), name, "uncompressed")


def _ranges(edges: DataFrame, name: str, inner: str | None = None) -> list[list[int]]:
    """For each column the ids at which a new range begins, such that ranges have about TARGET edges; those of inner are finer."""
    count = edges.count()
    n = max(-(-count // TARGET), min(LEAST, count // SMALL), 1)
    parts = {name: n} if inner is None else {name: n, inner: max(n, min(FINER * n, FINE))}
    if n == 1:
        return [[] for _ in parts]
    got = edges.agg(*(F.percentile_approx(x, [k / m for k in range(1, m)], max(1000, 20 * m)).alias(x) for x, m in parts.items())).first()
    return [sorted({int(x) for x in got[x]}) for x in parts]


def _meet(sides: list[tuple[DataFrame, list[str]]], pairs: DataFrame, kernel: Kernel, packed: int, once: bool, schema: str, last: Callable | None = None) -> DataFrame:
    """Each pair of ranges (i, k) in one task: bodies of A (0) and of B (1), whose edges pairs count (sent).  Where pairs also say how a body takes part, the mask's
    (2) come first, and those of A and B by the range j between them; tasks are told apart by g too."""
    masked, names = "side" in pairs.columns, [f.split()[0] for f in schema.split(", ")]
    if not masked:
        own = sum(side.agg(F.sum("n")).first()[0] or 0 for side, _ in sides)
        if (pairs.agg(F.sum("sent")).first()[0] or 0) > SENT * own:
            return _crossed(*(side for side, _ in sides), kernel, once, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[list[int], list[list[bytes]]]]:
            now, bodies = None, [[], [], []]
            for batch in batches:
                for *at, side, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now not in (None, at):
                        yield now, bodies
                        bodies = [[], [], []]
                    now = at
                    bodies[side].append(body)
            if now:
                yield now, bodies

        def results() -> Iterator[list[np.ndarray]]:
            unit, places = None, None
            for (*of, _), (a, b, mask) in blocks():
                if of != unit:
                    if last and places:
                        yield from last(places)
                    unit, places = of, None
                if mask:
                    places = _places(mask, once)
                if a and b and (places or not masked):
                    yield from kernel(_lines(a, packed, once), _lines(b, packed, once), places)
            if last and places:
                yield from last(places)

        for columns in results():
            for s in range(0, len(columns[0]), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + BATCH]) for c in columns], names=names)

    rows, unit = None, ["i", "k", "g"] if masked else ["i", "k"]
    for k, (side, on) in enumerate(sides):
        part = side.join(F.broadcast(pairs) if masked else pairs, on).select(*unit, *(["j", "side"] if masked else [F.lit(0).alias("j"), F.lit(k).alias("side")]), "body")
        rows = part if rows is None else rows.unionByName(part)
    n = max(1, min(4 * pairs.select(*unit).distinct().count() if masked else 2 * pairs.count(), 100_000))
    return rows.repartition(n, *unit).sortWithinPartitions(*unit, "j").mapInArrow(run, schema)


def _crossed(a: DataFrame, b: DataFrame, kernel: Kernel, once: bool, schema: str) -> DataFrame:
    """The same for whole products without a shuffle: each task reads a part of A's and a part of B's ranges where they lie."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, None
        for batch in batches:
            for i, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if i != now:
                    now, left = i, _lines([x.as_py()], 0, once)
                for columns in kernel(left, _lines([y.as_py()], 0, once), None):
                    for s in range(0, len(columns[0]), BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + BATCH]) for c in columns], names=names)

    def parts(side: DataFrame, at: str) -> DataFrame:
        ranges, n = side.agg(F.count("*"), F.sum("n")).first()
        return side.select(at, F.col("across").alias(f"across_{at}"), F.col("body").alias(f"body_{at}")).coalesce(max(1, min(PARTS, n // PART), ranges // HELD))

    met = parts(a, "i").hint("shuffle_replicate_nl").join(parts(b, "k"), F.arrays_overlap("across_i", "across_k"))
    return met.select("i", "body_i", "body_k").mapInArrow(run, schema)


def _grids(edges: list[tuple[DataFrame, list[list[str]]]], most: int, alike: bool) -> list[list[list[int]]]:
    """Ids at which ranges begin, for each list of columns of the edges: for as few ranges as blocks of TARGET edges need if there is
    no order among the ids, and for ranges of TARGET edges themselves, which are enough in any order."""
    least = max(min(LEAST, most // SMALL), 1)
    n = max(-(-most // TARGET), least)
    few = min(n, max(math.ceil(math.sqrt((1 + alike) * most / TARGET)), least))
    grids: list[list[list[int]]] = [[] for _ in {few, n}]
    for df, lists in edges:
        for columns in lists:
            fine = 1 if len(columns) == 1 else 4
            parts = [[k / (fine * m) for k in range(1, fine * m)] for m in sorted({few, n})]
            if n == 1:
                grids[0].append([])
                continue
            asked = sum(parts, [])
            got = df.agg(*(F.percentile_approx(c, asked, max(1000, 20 * n)).alias(c) for c in columns)).first()
            at = 0
            for grid, part, m in zip(grids, parts, sorted({few, n}), strict=True):
                ids = sorted(int(x) for c in columns for x in (got[c] or [])[at : at + len(part)])
                at += len(part)
                grid.append(sorted({ids[len(ids) * k // m] for k in range(1, m)} if fine > 1 else set(ids)) if ids else [])
    return grids


def _masked_product(a: DataFrame, b: DataFrame, mask: DataFrame, kernel: Kernel, packed: int, once: bool, schema: str, last: Callable | None = None) -> DataFrame:
    """Blocks (r, c) of each table t: A by the ranges i, j, B by k, j, the mask by i, k.  If B is A's transpose and the mask is A, all
    three are one table."""
    work = Workspace(a.sparkSession, "product")
    alike = mask.sameSemantics(a) and prep.transpose(a).sameSemantics(b)
    tables = [(a, "src")] if alike else [(a, "src"), (b, "dst"), (mask, "src")]
    most = max(df.count() for df, _ in tables)
    for name, grid in enumerate(grids := _grids([(a, [["src", "dst"]])] if alike else [(a, [["src"], ["dst"]]), (b, [["dst"]])], most, alike)):
        i, j, k = grid * 3 if alike else grid
        for t, ((df, line), own, across) in enumerate(zip(tables, (i, k, i), (j, j, k))):
            side = _packed(df, line, own, across, square=True).select(F.lit(t).alias("t"), F.col("blk").alias("r"), F.col("across")[0].alias("c"), "n", "body")
            held = work.put(side, f"packed-{name}", "uncompressed", "append")
        cells = work.put(held.groupBy("t", "r", "c").agg(F.sum("n").alias("n"), F.sum(F.octet_length("body")).alias("size")), f"cells-{name}")
        whole = cells.agg(F.max("n").alias("n"), F.sum("size").alias("size")).first()
        if name + 1 == len(grids) or (whole["n"] or 0) <= 2 * TARGET:
            break
        work.drop(f"packed-{name}")  # the ids have an order: blocks are too large
    of_b, of_mask = (0, 0) if alike else (1, 2)
    left, right, places = (
        cells.where(F.col("t") == t).select(F.col("r").alias(r), F.col("c").alias(c), F.col("size").alias(f"size_{x}"))
        for t, r, c, x in ((0, "i", "j", "a"), (of_b, "k", "j", "b"), (of_mask, "i", "k", "m"))
    )
    unit = ["i", "k", "g"]
    met = left.join(right, "j").join(places, ["i", "k"]).withColumn("g", F.floor(F.col("j") / SPAN) if last is None else F.lit(0).cast("long"))
    met = work.put(met, "met")
    ways = [(met, 0, 0, "i", "j", "j", "a"), (met, of_b, 1, "k", "j", "j", "b"), (met.dropDuplicates(unit), of_mask, 2, "i", "k", None, "m")]
    pairs = None
    for df, t, side, r, c, at, x in ways:
        part = df.select(
            F.lit(t).alias("t"), F.col(r).alias("r"), F.col(c).alias("c"), *unit, (F.col(at) if at else F.lit(-1).cast("long")).alias("j"), F.lit(side).alias("side"), F.col(f"size_{x}").alias("size")
        )
        pairs = part if pairs is None else pairs.unionByName(part)
    ranges = 1 + max(len(x) for x in grid)
    key = ((F.col("i") * ranges + F.col("k")) * ranges + F.col("g")).alias("key")
    units = prep.running(pairs.groupBy(key, *unit).agg(F.sum("size").alias("sent")), "key", "sent", "before")
    most = max(1, math.ceil((whole["size"] or 0) * WAVE))
    units = work.put(units.select(*unit, "sent", F.floor(F.col("before") / most).alias("wave")), "units")
    pairs = work.put(pairs.join(units, unit).drop("size", "sent"), "pairs")
    if units.agg(F.coalesce(F.sum("sent"), F.lit(0))).first()[0] <= most:
        return _meet([(held, ["t", "r", "c"])], pairs, kernel, packed, once, schema, last)
    for w in sorted(x[0] for x in units.select("wave").distinct().collect()):  # each one's shuffle files go before the next
        out = work.put(_meet([(held, ["t", "r", "c"])], pairs.where(F.col("wave") == w), kernel, packed, once, schema, last), "waves", mode="append")
    return out


def masked_counts(a: DataFrame, b: DataFrame, mask: DataFrame, once: bool = False) -> DataFrame:
    """(src, dst, val) of the counting product at the mask's places.  once, here and below: a repeated edge counts once."""
    packed = WORD if once else 0
    return _masked_product(a, b, mask, _counts(packed), packed, once, "src long, dst long, val long", _counted)


def masked_total(a: DataFrame, b: DataFrame, mask: DataFrame, packed: int = 0, once: bool = False) -> DataFrame:
    """One row (total): the sum of the masked product, by AND and population count of words (by lookup where repeated edges count)."""
    packed = packed or (WORD if once else 0)
    parts = _masked_product(a, b, mask, _totals(packed), packed, once, "n long")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


def masked_corners(a: DataFrame, b: DataFrame, mask: DataFrame, once: bool = False) -> DataFrame:
    """(v, n): how many of the masked product's terms i, j, k each vertex is one of."""
    parts = _masked_product(a, b, mask, _corners, 0, once, "v long, part long")
    return parts.groupBy("v").agg(F.sum("part").alias("n"))


def _whole(a: DataFrame, b: DataFrame, kernel: Callable[[list[int]], Kernel], once: bool, schema: str, valued: bool = False) -> DataFrame:
    """kernel: made of the ids at which B's ranges begin."""
    work = Workspace(a.sparkSession, "product")
    (rows, inner), (cols,) = _ranges(a, "src", "dst"), _ranges(b, "dst")
    left = _side(work, a, "a", "src", rows, inner, once, valued).withColumnRenamed("blk", "i")
    right = _side(work, b, "b", "dst", cols, inner, once, valued).withColumnRenamed("blk", "k")
    names, others = left.select("i", "across", "n"), right.select("k", F.col("across").alias("over"), F.col("n").alias("m"))
    pairs = work.put(names.join(others, F.arrays_overlap("across", "over")).select("i", "k", (F.col("n") + F.col("m")).alias("sent")), "pairs")
    return _meet([(left, ["i"]), (right, ["k"])], pairs, kernel(cols), 0, once, schema)


def product(a: DataFrame, b: DataFrame, kind: str, once: bool = False) -> DataFrame:
    """(src, dst[, val]) of all entries; kind is count, bool or weighted (both sides then have a weight)."""
    schema = "src long, dst long" + {"count": ", val long", "bool": "", "weighted": ", val double"}[kind]
    return _whole(a, b, lambda _: _product(kind), once, schema, kind == "weighted")


def product_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, n): how many entries each row of the boolean product has, without the entries themselves."""
    parts = _whole(a, b, _sizes, True, "src long, slot long, word long, n long")
    words = parts.groupBy("src", "slot").agg(F.bit_or("word").alias("word"), F.sum("n").alias("n"))
    return words.groupBy("src").agg(F.sum(F.bit_count("word") + F.col("n")).cast("long").alias("n"))
