"""Benchmark passages in documents, within an edit distance of words.

An item matches a passage if at most a fifth of its words (by default) are inserted, deleted or replaced.  Every
item-sized window around an intact piece of an item is a candidate: a match within k edits leaves one of k + 1 disjoint
pieces of the item intact, so no match is lost there.  Windows and items are embedded by the CGK random walk, which turns
edit distance into Hamming distance: each output takes the walker's symbol, and a random function of the symbol and the
step says whether the walker moves on.  Sampled places of the outputs are the keys of an LSH table; walks and samples are
repeated until the expected recall at the largest distance reaches the target.  What collides is verified exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, words

STRETCH = 3  # outputs of the walk for each word
SAMPLED = 2  # places in a table's key
_END = np.uint64(0)
#: Items go in blocks of about so many bytes, each broadcast in one pass over the documents.
BLOCK_BYTES = 8 << 20
#: Items of fewer words must match in every word.
SHORT = 8


def walk(symbols: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """The sampled places (ascending) of the embedding of each row of word hashes, as one key a row."""
    n, size = symbols.shape
    at = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([symbols, np.full((n, 1), _END)], axis=1)
    rows, key = np.arange(n), np.zeros(n, dtype=np.uint64)
    wanted = set(places.tolist())
    for step in range(int(places[-1]) + 1):
        symbol = padded[rows, at]
        coin = words.mix(symbol + np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1342543DE82EF95) & (1 << 64) - 1))
        if step in wanted:
            key = words.mix(key ^ symbol) + np.uint64(1)
        at = np.minimum(at + (coin >> np.uint64(63)).astype(np.int64), size)
    return key


def sample(size: int, table: int) -> np.ndarray:
    """The places that a table samples of the embedding of `size` words."""
    return np.sort(np.random.default_rng((size, table)).choice(STRETCH * size, min(SAMPLED, STRETCH * size), replace=False))


def allowed(size: int, share: float) -> int:
    return int(size * share + 1e-9) if size >= SHORT else 0


@lru_cache(256)
def repetitions(share: float, recall: float, size: int = 40, trials: int = 400) -> int:
    """Tables for the recall, from the rate of collisions at the largest distance, measured on random edits: the lower one
    of edits of all kinds and of changed words alone."""
    rates = []
    for kinds in (3, 1):
        rng = np.random.default_rng(7)
        rate = 0.0
        for t in range(trials // 20):
            x = rng.integers(1, 1 << 63, (20, size), dtype=np.uint64)
            y = np.stack([edited(row, allowed(size, share), rng, kinds)[:size] for row in x])
            places = sample(size, t)
            rate += float((walk(x, places, t) == walk(y, places, t)).mean()) / (trials // 20)
        rates.append(rate)
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(max(min(rates), 0.02), 0.999)))))


def tables_for(size: int, share: float, recall: float) -> int:
    """Tables for items of so many words: as many as the next power of two asks for, and no fewer than a usual item."""
    return max(repetitions(share, recall), repetitions(share, recall, 1 << max(3, (min(size, 512) - 1).bit_length())))


def edited(row: np.ndarray, edits: int, rng: np.random.Generator, kinds: int = 3) -> np.ndarray:
    """A row of words after so many random edits (changed words, then insertions, then deletions), filled up to its size."""
    out = row.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(len(out))), int(rng.integers(kinds))
        new = int(rng.integers(1, 1 << 62))
        out = out[:at] + ([new] if kind == 0 else [new, out[at]] if kind == 1 else []) + out[at + 1 :]
    return np.array((out + [int(v) for v in rng.integers(1, 1 << 62, len(row))])[: max(len(row), 1)], dtype=np.uint64)


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the part of the text nearest to the item; the leftmost end of the shortest distance."""
    m = len(text)
    steps = np.arange(m + 1)
    cost, start = np.zeros(m + 1, dtype=np.int64), steps.copy()
    for i, word in enumerate(item, 1):
        new = np.empty(m + 1, dtype=np.int64)
        origin = np.empty(m + 1, dtype=np.int64)
        new[0], origin[0] = i, 0
        change, drop = cost[:-1] + (text != word), cost[1:] + 1
        new[1:] = np.minimum(change, drop)
        origin[1:] = np.where(change <= drop, start[:-1], start[1:])
        # Words of the text that are inserted: the least of what lies to the left, plus the way from there.
        shifted = new - steps
        best = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == best, steps, 0))
        cost, start = best + steps, origin[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class Items:
    """A block of benchmark items: word hashes, and the hashed pieces of which one must be intact."""

    def __init__(self, ids: list[int], texts: list[str | None], share: float, recall: float):
        self.share = share
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for w in words.split(pa.array(texts, pa.string()), lower=True, marks=False):
            for k in range(len(w.first) - 1):
                own = w.hash[w.first[k] : w.first[k + 1]]
                if len(own):
                    self.ids.append(ids[w.rows.start + k])
                    self.words.append(own.copy())
        self.tables = {n: tables_for(n, share, recall) for n in {len(x) for x in self.words}}
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for i, own in enumerate(self.words):
            k = allowed(len(own), share)
            size = len(own) // (k + 1)
            for part in range(k + 1):
                at = part * len(own) // (k + 1)
                pieces.setdefault(size, []).append((int(words.windows(own[at : at + size], size)[0]), i, at))
        self.pieces = {}
        for size, found in pieces.items():
            hashed = np.array([h for h, _, _ in found], dtype=np.uint64)
            order = np.argsort(hashed, kind="stable")
            flags = np.zeros(1 << 20, dtype=bool)
            flags[(hashed & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.pieces[size] = flags, hashed[order], np.array([(i, at) for _, i, at in found], dtype=np.int64)[order]

    def seeds(self, w: words.Words) -> np.ndarray:
        """(document, item, word where the item would begin) for every intact piece."""
        out = [np.zeros((0, 3), dtype=np.int64)]
        for size, (flags, hashed, where) in self.pieces.items():
            own = words.windows(w.hash, size)
            if not len(own):
                continue
            at = np.flatnonzero(flags[(own & np.uint64((1 << 20) - 1)).view(np.int64)])
            at = at[words.window_mask(w.first, size)[at]]
            low, high = np.searchsorted(hashed, own[at], side="left"), np.searchsorted(hashed, own[at], side="right")
            at, low, count = at[high > low], low[high > low], (high - low)[high > low]
            which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = np.repeat(at, count)
            doc = np.searchsorted(w.first, place, side="right") - 1
            out.append(np.stack([doc, where[which, 0], place - where[which, 1]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, w: words.Words) -> list[tuple[int, int, int, int, int]]:
        """(row, item_id, first word, words, edits): the best passage for each document and item within the distance."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        seeds = self.seeds(w)
        for i in np.unique(seeds[:, 1]).tolist():
            item = self.words[i]
            n, k = len(item), allowed(len(item), self.share)
            own = seeds[seeds[:, 1] == i]
            # All windows of the item's size that begin within k words of where the piece puts it.
            doc = np.repeat(own[:, 0], 2 * k + 1)
            begin = (own[:, 2][:, None] + np.arange(-k, k + 1)).reshape(-1)
            low, high = w.first[doc], w.first[doc + 1]
            begin = np.clip(begin, low, np.maximum(high - n, low))
            pairs = np.unique(np.stack([doc, begin], axis=1), axis=0)
            doc, begin = pairs[:, 0], pairs[:, 1]
            for d, b in self._collide(w, item, doc, begin).tolist():
                low, high = max(int(w.first[d]), b - k), min(int(w.first[d + 1]), b + n + k)
                key = d, i
                if key in best and best[key][2] == 0:
                    continue
                edits, start, end = distance(item, w.hash[low:high])
                if edits <= k and (key not in best or (edits, low + start) < (best[key][2], best[key][0])):
                    best[key] = low + start, end - start, edits
        return [(d, self.ids[i], b - int(w.first[d]), size, edits) for (d, i), (b, size, edits) in best.items()]

    def _collide(self, w: words.Words, item: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The windows that meet the item in some table, the first of each run of neighbours."""
        n, found = len(item), []
        for table in range(self.tables[n]):
            if not len(doc):
                break
            at = begin[:, None] + np.arange(n)
            rows = np.where(at < w.first[doc + 1][:, None], w.hash[np.minimum(at, len(w.hash) - 1)], _END)
            places = sample(n, table)
            hit = walk(rows, places, table) == walk(item[None, :], places, table)[0]
            if hit.any():
                found.append(np.stack([doc[hit], begin[hit]], axis=1))
            doc, begin = doc[~hit], begin[~hit]
        if not found:
            return np.zeros((0, 2), dtype=np.int64)
        rows = np.unique(np.concatenate(found), axis=0)
        # One window stands for those that begin within the same stretch, since verification looks k words around it.
        k = max(1, allowed(n, self.share) // 2)
        return rows[np.unique(np.stack([rows[:, 0], rows[:, 1] // k], axis=1), axis=0, return_index=True)[1]]


_SCHEMA = "doc_id long, item_id long, first_word long, n_words long, edits long"


def _find(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for w in words.split(batch.column(1), lower=True, marks=False):
                found = items.matches(w)
                if found:
                    row, *rest = zip(*found, strict=True)
                    keys = batch.column(0)[w.rows].take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int64()) for x in rest)], names=["doc_id", "item_id", "first_word", "n_words", "edits"])

    return run


def _without(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for w in words.split(batch.column("text"), lower=True, marks=False):
                keep[[w.rows.start + x[0] for x in items.matches(w)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, share: float, recall: float) -> Iterator:
    """Broadcasts of the items, a bounded block at a time, and whether it is the last one."""
    spark = benchmark.sparkSession
    items = tables.texts(benchmark, "item_id").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Items([r["item_id"] for r in own], [r["text"] for r in own], share, recall)), b == blocks - 1


def without(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.99) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no passage of the benchmark (see `passages`)."""
    work = tables.Workspace(docs.sparkSession, "without")
    for k, (block, last) in enumerate(_blocks(benchmark, share, recall)):
        docs = docs.mapInArrow(_without(block), docs.schema)
        if not last:  # one block at a time is held
            docs = work.put(docs, f"block-{k}")
            block.destroy()
            work.drop(f"block-{k - 1}")
    return docs


def passages(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.99) -> DataFrame:
    """One row for each document and benchmark item of which it holds a passage: the nearest one, the first of equals.

    Words are runs of ASCII letters and digits and of all other characters but ASCII ones, A-Z in lower case.  An item
    of n words may differ in floor(share * n) words; items of fewer than 8 words must be met exactly, and items without
    words or without text match nothing, as do null and empty documents.  Repeated items and documents are each looked
    for; rows with a null doc_id are reported with it.  Very long texts are searched whole, one at a time.  Columns other than doc_id, item_id and text are not read.

    The items go in blocks of bounded size, each in one pass over all documents, without a shuffle; what all but the last
    one find is written, so that one block at a time is held.
    """
    work, found = tables.Workspace(docs.sparkSession, "passages"), []
    for k, (block, last) in enumerate(_blocks(benchmark, share, recall)):
        found.append(tables.texts(docs).mapInArrow(_find(block), _SCHEMA))
        if not last:
            found[-1] = work.put(found[-1], f"block-{k}")
            block.destroy()
    return reduce(DataFrame.unionByName, found)
