"""Removal of passages that repeat: windows of words, found level by level at doubling lengths.

Every window of the full length chooses, at each level, the smallest hash among its sub-windows of that level's length
(its anchor), so equal windows choose equal anchors.  A window whose anchor occurs only once is unique and is dropped;
those left are looked at again at twice the length, and at last at the full length itself, until no candidates survive
or the full length has been checked.  Only a level's anchors are shuffled, about 2 / (window - length + 2) of the words.
The full length is checked by two 64-bit hashes together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, words


def slide(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best() over every n consecutive values, by doubling."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def _alive_values(hashed: np.ndarray, first: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the sub-windows (never 0), each window's anchor, and which windows lie within a unit (document or region)."""
    sub = np.maximum(words.windows(hashed, length), np.uint64(1))
    anchor = slide(sub, window - length + 1, np.minimum) if len(hashed) >= window else np.zeros(0, np.uint64)
    return sub, anchor, words.window_mask(first, window)


def anchors(hashed: np.ndarray, first: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """The hash of every place that is the anchor of some window, a second one at full length, and each unit's first place."""
    sub, anchor, inside = _alive_values(hashed, first, length, window)
    exact = length == window
    if not inside.any():
        none = np.zeros(0, np.uint64)
        return none, none if exact else None, np.zeros(len(first), np.int64)
    # A place is chosen if the largest anchor of the windows around it is its own hash; 0 stands for no window.
    reach = window - length
    padded = np.zeros(len(anchor) + 2 * reach, dtype=np.uint64)
    padded[reach : reach + len(anchor)] = np.where(inside, anchor, np.uint64(0))
    at = np.flatnonzero(slide(padded, reach + 1, np.maximum) == sub)
    return sub[at], words.windows(hashed, length, 1)[at] if exact else None, np.searchsorted(at, first)


def surviving(hashed: np.ndarray, first: np.ndarray, hits: list[np.ndarray], unit_row: np.ndarray, length: int, window: int) -> np.ndarray:
    """Which windows have an anchor among the hits of their row."""
    _, anchor, inside = _alive_values(hashed, first, length, window)
    alive = np.zeros(len(anchor), dtype=bool)
    for unit in range(len(first) - 1):
        own = hits[unit_row[unit]]
        if len(own):
            a, b = first[unit], first[unit + 1] - window + 1
            if b > a:
                alive[a:b] = np.isin(anchor[a:b], own)
    return alive & inside


def _regions(alive: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges covered by runs of surviving windows (runs are kept apart, so ranges may overlap)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], alive.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] + window - 1


# Rows between the jobs: a text (its MD5) with its regions' starts, lengths and word hashes.
_REGIONS = "key binary, starts array<int>, lengths array<int>, words binary"
#: At the full length, `more` is a second hash of each place; before, it is null.
_ANCHORS = "key binary, hashes array<long>, more array<long>"


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values)).cast(pa.list_(kind))


def _anchor_rows(keys: list[pa.Array], names: list[str], hashed: np.ndarray, first: np.ndarray, rows: np.ndarray, length: int, window: int) -> pa.RecordBatch:
    """Anchors of units, listed by row: `rows` holds each row's first unit, and one more."""
    found, more, begin = anchors(hashed, first, length, window)
    begin = begin[rows]
    second = _lists(more.view(np.int64), begin, pa.int64()) if more is not None else pa.nulls(len(rows) - 1, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([*keys, _lists(found.view(np.int64), begin, pa.int64()), second], names=[*names, "hashes", "more"])


def _document_anchors(length: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words.split(batch.column("text")):
                keys = [batch.column(k)[w.rows] for k in ("doc_id", "key")]
                yield _anchor_rows(keys, ["doc_id", "key"], w.hash, w.first, np.arange(len(w.first)), length, window)

    return run


def _units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all regions, each region's first word, its row in the batch and its start in the document."""
    sizes = batch.column("lengths")
    flat = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), np.diff(sizes.offsets.to_numpy()))
    hashed = np.frombuffer(b"".join(batch.column("words").to_pylist()), dtype=np.uint64)
    return hashed, np.append(0, np.cumsum(flat)), row, batch.column("starts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of regions whose words take about so many bytes together."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        total = np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, np.int64)
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, side="right"))
            end = max(end, begin + 1)
            yield batch.slice(begin, end - begin)
            begin = end


def _region_anchors(length: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hashed, first, row, _ = _units(batch)
            yield _anchor_rows([batch.column("key")], ["key"], hashed, first, np.searchsorted(row, np.arange(batch.num_rows + 1)), length, window)

    return run


def _rows(batch: pa.RecordBatch, kept: list[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]) -> pa.RecordBatch:
    at = pa.array([k for k, *_ in kept], pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            batch.column("key").take(at),
            pa.array([s.tolist() for _, s, _, _ in kept], pa.list_(pa.int32())),
            pa.array([n.tolist() for _, _, n, _ in kept], pa.list_(pa.int32())),
            pa.array([b"".join(x.tobytes() for x in parts) for *_, parts in kept], pa.binary()),
        ],
        names=["key", "starts", "lengths", "words"],
    )


def _hits(batch: pa.RecordBatch) -> list[np.ndarray]:
    own = batch.column("hits")
    flat, at = own.flatten().to_numpy(zero_copy_only=False).view(np.uint64), own.offsets.to_numpy()
    at = at - at[0]
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _cut(batch: pa.RecordBatch, hashed: np.ndarray, first: np.ndarray, row: np.ndarray, offset: np.ndarray, alive: np.ndarray, window: int) -> pa.RecordBatch:
    """The regions that surviving windows cover, by row of the batch."""
    begin, end = _regions(alive, window)
    unit = np.searchsorted(first, begin, side="right") - 1
    kept = []
    for k in np.unique(row[unit]).tolist():
        own = np.flatnonzero(row[unit] == k) if len(begin) < 64 else slice(*np.searchsorted(row[unit], [k, k + 1]))
        b, e, u = begin[own], end[own], unit[own]
        kept.append((k, b - first[u] + offset[u], e - b, [hashed[x:y] for x, y in zip(b, e, strict=True)]))
    return _rows(batch, kept)


def _document_regions(length: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = _hits(batch) if batch.num_rows else []
            for w in words.split(batch.column("text")):
                part = batch.slice(w.rows.start, w.rows.stop - w.rows.start)
                n = part.num_rows
                alive = surviving(w.hash, w.first, hits[w.rows], np.arange(n), length, window)
                yield _cut(part, w.hash, w.first, np.arange(n), np.zeros(n, np.int64), alive, window)

    return run


def _region_regions(length: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hashed, first, row, offset = _units(batch)
            alive = surviving(hashed, first, _hits(batch), row, length, window)
            yield _cut(batch, hashed, first, row, offset, alive, window)

    return run


def _hit_lists(work: tables.Workspace, found: DataFrame, exact: bool, level: int) -> DataFrame:
    """The texts that hold an anchor which occurs more than once, with those anchors."""
    columns = ["hashes", "more"] if exact else ["hashes"]
    if exact:
        each = found.select("key", F.inline(F.arrays_zip("hashes", "more")))
    else:
        each = found.select("key", F.explode("hashes").alias("hashes"))
    repeated = work.put(each.groupBy(*columns).count().where("count > 1").select(*columns), f"repeated-{level}")
    own = each.join(repeated, columns, "left_semi")
    # Hits grow with the input, so joins with them are planned alike at every size: both sides dealt out by key.
    return own.groupBy("key").agg(F.collect_set("hashes").alias("hits")).hint("merge")


def _keyed(docs: DataFrame) -> DataFrame:
    return tables.texts(docs).withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def levels(window: int, start: int = 9) -> list[int]:
    """The length of each level: about `start` words, doubled up to the window."""
    out = [window]
    while out[-1] > start:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def repeated_regions(docs: DataFrame, window: int, work: tables.Workspace) -> DataFrame:
    """(key, copies, starts, lengths) of the texts with a repeated window: how often the whole text occurs, and the word
    ranges that windows cover which occur in another text, or twice in this one (null: none).

    Each text goes through the levels once, however many rows bear it: with two, all of its windows repeat anyway.
    """
    rows, regions = _keyed(docs), None
    for k, length in enumerate(levels(window)):
        exact = length == window
        if regions is None:
            schema = f"doc_id long, {_ANCHORS}"
            found = work.put(rows.mapInArrow(_document_anchors(length, window), schema).where(F.size("hashes") > 0), "anchors-all")
            copies = work.put(found.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep")), "copies")
            one = found.join(copies.withColumnRenamed("key", "k").hint("merge"), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
            found = work.put(one.select("key", "hashes", "more"), f"anchors-{k}")
            work.drop("anchors-all")
            hits = _hit_lists(work, found, exact, k).join(copies, "key").select(F.col("key").alias("k"), "rep", "hits").hint("merge")
            joined = rows.join(hits, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep")))
            cut = joined.select("key", "text", "hits").mapInArrow(_document_regions(length, window), _REGIONS)
        else:
            found = work.put(regions.mapInArrow(_region_anchors(length, window), _ANCHORS), f"anchors-{k}")
            cut = regions.join(_hit_lists(work, found, exact, k), "key").mapInArrow(_region_regions(length, window), _REGIONS)
        regions = work.put(cut.select("key", "starts", "lengths") if exact else cut, f"regions-{k}")
        work.drop(f"anchors-{k}", f"repeated-{k}", *([f"regions-{k - 1}"] if k else []))
        if not exact and regions.isEmpty():
            break  # no candidates survive
    return copies.where("copies > 1").select("key", "copies").join(regions.select("key", "starts", "lengths").dropDuplicates(["key"]), "key", "full_outer")


def _kept(digest: bool, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, copies, starts, lengths in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                own = text.encode().split() if text else []
                total.append(len(own))
                if copies and len(own) >= window:
                    own = []
                elif starts:
                    out = bytearray(len(own))
                    for a, n in zip(starts, lengths, strict=True):
                        out[a : a + n] = b"\x01" * n
                    own = [w for w, x in zip(own, out, strict=True) if not x]
                removed.append(total[-1] - len(own))
                joined = b" ".join(own)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"],
            )

    return run


def remove(docs: DataFrame, window: int = 35, digest: bool = False) -> DataFrame:
    """Each document without the words of any window whose words also start anywhere else, the same document included.

    Windows are judged on the input.  Words are runs without ASCII white space, taken unchanged; what is kept is joined
    by single spaces.  Null and empty texts, and texts shorter than a window, lose nothing.  Repeated rows repeat each
    other; a null doc_id is a document like any other.  Very long texts are hashed whole, one at a time; an empty table gives
    no rows.  Columns other than doc_id and text are not read.
    """
    work = tables.Workspace(docs.sparkSession, "repeats")
    rows = _keyed(docs)
    own = repeated_regions(docs, window, work).withColumnRenamed("key", "k").hint("merge")
    spans = rows.join(own, F.col("key") == F.col("k"), "left").select("doc_id", "text", "copies", "starts", "lengths")
    schema = f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string"
    return spans.mapInArrow(_kept(digest, window), schema)
