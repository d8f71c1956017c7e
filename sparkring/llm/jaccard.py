"""Exact Jaccard join of documents on word shingles, with adaptive multi-match prefixes.

Documents with the same set of shingles form a class at once; one document of each goes on.  Shingles are ordered by a
sketch of their frequency (rare first, then by hash), the same order everywhere.  Two sets of which the smaller bound on
the overlap is t share at least l shingles among their first n - t + l, so each document takes the l that costs least by
the sketch, and a pair is verified only if it shares as many prefix shingles as the smaller l of the two, and if the
places of the shared ones still allow the overlap.

Lists of documents under one prefix shingle are paired in full while short.  Under a common shingle, documents are first
linked through the one that has the fewest rarer shingles; only pairs that are still in different components, and of
sizes that may link, are then compared, block against block, so that no link is lost and nothing is emitted for pairs that
cannot change a component.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import contract as components
from . import fold, tables, words

#: Least and most buckets of the sketch (a power of two, one for each so many bytes of text): 4 bytes each are broadcast.
SKETCH = 1 << 22, 1 << 24
SKETCH_BYTES = 512
MOST_MATCHES = 4
SHORT_LIST = 64
#: A shingle is common, and not dealt out by key, if its bucket holds more than the usual one by all of: so many documents,
#: one of 2**20 of all entries, and eight times the spread between buckets.  So the share counts, whatever the input's size.
COMMON, COMMON_SHARE, COMMON_SPREAD = 1024, 20, 8
BLOCK = 512


def shingle_sets(column: pa.Array, size: int, lower: bool = True) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, distinct shingle hashes of each document in ascending order, and each document's first one.

    With fewer words than `size`, the whole sequence is one shingle; without words there is none.
    """
    for w in words.split(column, lower=lower):
        n, count = len(w.first) - 1, w.counts()
        inside = words.window_mask(w.first, size)
        at = np.flatnonzero(inside)
        value = words.windows(w.hash, size)[at] if len(at) else np.zeros(0, np.uint64)
        doc = np.searchsorted(w.first, at, side="right") - 1
        few = np.flatnonzero((count > 0) & (count < size))
        if len(few):
            whole = np.array([words.windows(w.hash[w.first[k] : w.first[k + 1]], int(count[k]))[0] for k in few], dtype=np.uint64)
            doc, value = np.concatenate([doc, few]), np.concatenate([value, whole])
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        yield w.rows, value[new], np.searchsorted(doc[new], np.arange(n + 1))


def _digests(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    out = []
    for salt in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03):
        total = np.append(np.uint64(0), np.cumsum(words.mix(value ^ np.uint64(salt))))
        out.append(words.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    return (words.mix(value) & np.uint64(buckets - 1)).astype(np.int64)


def buckets_for(size: int) -> int:
    """Buckets of the sketch for so many bytes of text."""
    return min(SKETCH[1], max(SKETCH[0], 1 << max(0, size // SKETCH_BYTES).bit_length()))


class Sketch:
    """Entries in each bucket, those of a usual bucket, and from how many on a shingle is common."""

    def __init__(self, counts: np.ndarray):
        self.counts = np.minimum(counts, (1 << 31) - 1).astype(np.int32)
        self.usual, upper = (int(x) for x in np.quantile(counts, (0.5, 0.9), method="nearest"))
        self.common = self.usual + max(COMMON, int(counts.sum()) >> COMMON_SHARE, COMMON_SPREAD * (upper - self.usual))

    def __call__(self, value: np.ndarray) -> np.ndarray:
        return self.counts[_bucket(value, len(self.counts))].astype(np.int64)


_FIRST = "doc_id long, n long, d1 long, d2 long, key string, counts binary"


def _first(size: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.uint32)
        for batch in batches:
            for rows, value, first in shingle_sets(batch.column(1), size):
                np.add.at(total, _bucket(value, buckets), np.uint32(1))
                d1, d2 = _digests(value, first)
                n = len(first) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(np.diff(first)), pa.array(d1), pa.array(d2), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "key", "counts"],
                )
        parts = fold.rows("sketch", total)
        none = pa.nulls(parts.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, parts.column(0), parts.column(1)], names=["doc_id", "n", "d1", "d2", "key", "counts"])

    return run


def needed(a, b, percent: int):
    """Least overlap of sets of these sizes that link."""
    return -(-percent * (a + b) // (100 + percent))


def choose(counts: np.ndarray, n: int, percent: int) -> int:
    """How many matches a document asks for: the cheapest by estimated list lengths and verifications."""
    bound = -(-n * percent // 100)
    best, cost = 1, np.inf
    length = np.cumsum(counts[: n - bound + MOST_MATCHES])
    for matches in range(1, min(MOST_MATCHES, bound) + 1):
        scanned = float(length[min(n - bound + matches, n) - 1])
        own = scanned + scanned / matches * (1 + n / 64)
        if own < cost:
            best, cost = matches, own
    return best


def _prefixes(shared, size: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for rows, value, first in shingle_sets(batch.column(1), size):
                counts = sketch(value)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                order = np.lexsort((value, counts, doc))
                value, counts = value[order], counts[order]
                out = []
                for k in np.flatnonzero(np.diff(first)).tolist():
                    a, b = int(first[k]), int(first[k + 1])
                    n = b - a
                    matches = choose(np.maximum(counts[a:b] - sketch.usual, 1), n, percent)
                    end = a + min(n, n - -(-n * percent // 100) + matches)
                    cold = int(np.searchsorted(counts[a:end] >= sketch.common, True))
                    out.append((keys[rows.start + k], n, matches, cold, value[a:end].view(np.int64)))
                ids, sizes, asked, cold, tokens = zip(*out, strict=True) if out else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(asked, pa.int32()), pa.array(cold, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))],
                    names=["doc", "n", "matches", "cold", "tokens"],
                )

    return run


_PREFIX = "doc long, n int, matches int, cold int, tokens array<long>"
_FOUND = "token long, x long, nx int, mx int, px int, y long, ny int, my int, py int"


def _pair_up(percent: int) -> Callable:
    """Sorted postings -> pairs of short lists, and the postings of long ones (y null)."""

    def table(x: dict[str, np.ndarray], y: dict[str, np.ndarray] | None) -> pa.RecordBatch:
        n = len(x["doc"])
        own = [pa.array(x[k], t) for k, t in (("token", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("matches", pa.int32()), ("at", pa.int32()))]
        other = [pa.array(y[k], t) if y else pa.nulls(n, t) for k, t in (("doc", pa.int64()), ("n", pa.int32()), ("matches", pa.int32()), ("at", pa.int32()))]
        return pa.RecordBatch.from_arrays([*own, *other], names=["token", "x", "nx", "mx", "px", "y", "ny", "my", "py"])

    def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        token = rows["token"]
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(token)))
        left, right = [], []
        for length in np.unique(size[size > 1]).tolist():
            i, j = np.triu_indices(length, 1)
            at = begin[size == length][:, None]
            left.append((at + i).reshape(-1))
            right.append((at + j).reshape(-1))
        if not left:
            return
        a, b = np.concatenate(left), np.concatenate(right)
        swap = rows["doc"][a] > rows["doc"][b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        n, m, p, q = rows["n"][a], rows["n"][b], rows["at"][a], rows["at"][b]
        ok = (rows["doc"][a] != rows["doc"][b]) & (np.minimum(p, q) + np.minimum(n - p, m - q) >= needed(n, m, percent))
        ok &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        a, b = a[ok], b[ok]
        for s in range(0, len(a), 50_000):
            yield table({k: v[a[s : s + 50_000]] for k, v in rows.items()}, {k: v[b[s : s + 50_000]] for k, v in rows.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "doc", "n", "matches", "at")
        held = {k: np.zeros(0, np.int64) for k in names}
        long_token = None  # of a list that has grown too long: its postings go out as they come
        for batch in batches:
            rows = {k: np.concatenate([held[k], batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for k in names}
            token = rows["token"]
            if not len(token):
                continue
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(begin, len(token)))
            long = size > SHORT_LIST
            if long_token is not None and token[0] == long_token:
                long[0] = True
            each = np.repeat(long, size)
            if each.any():
                yield table({k: v[each] for k, v in rows.items()}, None)
            long_token = int(token[-1]) if long[-1] else None
            last = np.zeros(len(token), dtype=bool)
            if not long[-1]:
                last[begin[-1] :] = True
            held = {k: v[last] for k, v in rows.items()}
            rest = ~each & ~last
            yield from pairs({k: v[rest] for k, v in rows.items()})
        yield from pairs(held)

    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, value, first in shingle_sets(batch.column(1), size):
                raw = [value[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(raw, pa.binary())], names=["doc", "own"])

    return run


def _verify(percent: int) -> Callable:
    """Rows sorted by x, x's own sets (y null) first -> linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, []
        for batch in batches:
            u, v = [], []
            for x, y, raw in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "own")), strict=True):
                if x != current:
                    current, own = x, []
                value = np.frombuffer(raw, dtype=np.uint64)
                if y is None:
                    own.append(value)
                elif any(linked(z, value, percent) for z in own):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets are as similar as asked."""
    if not len(a) or not len(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _blocks(percent: int) -> Callable:
    """One block of documents under a shingle against another: pairs in different components that may link."""
    import pandas as pd

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        token, _, i, j = key
        left, right = rows[rows.block == i], rows[rows.block == j]
        return pd.DataFrame(compare(token, left, right, i == j, percent), columns=["x", "y"])

    return run


def compare(token: int, left, right, same: bool, percent: int) -> list[tuple[int, int]]:
    """Pairs whose first common shingle among the long lists is `token`, that match often enough and early enough.

    Of two documents that are both guests of a band of sizes (`home` is false), the pair belongs to another band.
    """
    column = {t: k for k, t in enumerate(sorted({t for x in right.tokens for t in x}))}
    place = np.full((len(right), len(column)), 1 << 30, dtype=np.int32)
    for r, own in enumerate(right.tokens):
        place[r, [column[t] for t in own]] = np.arange(len(own))
    hots = sorted({t for x in right.hots for t in x if t < token})
    hot = {t: k for k, t in enumerate(hots)}
    earlier = np.zeros((len(right), len(hots)), dtype=bool)
    for r, own in enumerate(right.hots):
        earlier[r, [hot[t] for t in own if t in hot]] = True
    doc, comp, n, asked = (right[k].to_numpy() for k in ("doc", "comp", "n", "matches"))
    at_home = lambda x: x.home.to_numpy() if "home" in x else np.ones(len(x), dtype=bool)
    home = at_home(right)
    out: list[tuple[int, int]] = []
    for x, c, m, ask, here, tokens, own in zip(left.doc, left.comp, left.n, left.matches, at_home(left), left.tokens, left.hots, strict=True):
        ok = (comp != c) & (home | here) & (doc != x) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        if same:
            ok &= doc > x
        before = [hot[t] for t in own if t in hot]
        if before:
            ok &= ~earlier[:, before].any(axis=1)
        if not ok.any():
            continue
        at = np.array([k for k, t in enumerate(tokens) if t in column])
        if not len(at):
            continue
        near = place[np.flatnonzero(ok)][:, [column[tokens[k]] for k in at]]
        shared = near < 1 << 30
        count = shared.sum(axis=1)
        p, q = at[shared.argmax(axis=1)], np.where(shared, near, 1 << 30).min(axis=1)
        good = (count >= np.minimum(asked[ok], ask)) & (np.minimum(m - p, n[ok] - q) >= needed(n[ok], m, percent))
        out += [(min(x, y), max(x, y)) for y in doc[ok][good].tolist()]
    return out


class Join:
    """The steps of one join; tables between them lie in the shared folder."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = tables.texts(docs).where("doc_id is not null"), size, percent
        self.spark = docs.sparkSession
        self.work = tables.Workspace(self.spark, "jaccard")
        self.all = tables.texts(docs)

    def classes(self) -> tuple[DataFrame, DataFrame, Sketch]:
        """Every document with its size and class digests, the classes with their smallest doc_id, and the sketch."""
        buckets = buckets_for(self.all.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        first = self.work.put(self.all.mapInArrow(_first(self.size, buckets), _FIRST), "first")
        sketch = fold.collect(first.where("key is not null").select("key", "counts"), {"sketch": buckets})["sketch"]
        members = first.where("key is null").select("doc_id", "n", "d1", "d2")
        found = self.work.put(members.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc")), "classes")
        return members, found, Sketch(sketch)

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Links (u, v) among the pairs (x, y); x should be the rarer one of a hub's pairs."""
        pairs = self.work.put(pairs.select("x", "y").distinct(), f"pairs-{name}")
        ids = pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct()
        # The ids grow with the input, so this join is planned alike at every size: both sides dealt out by key.
        sets = self.work.put(self.docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(self.size), "doc long, own binary").distinct(), f"sets-{name}")
        asked = pairs.join(sets, pairs["y"] == sets["doc"]).select("x", "y", "own")
        own = sets.join(pairs.select("x").distinct(), sets["doc"] == F.col("x"), "left_semi").select(F.col("doc").alias("x"), F.lit(None).cast("long").alias("y"), "own")
        rows = own.unionByName(asked).repartition(tables.partitions(self.spark), "x").sortWithinPartitions("x", F.col("y").asc_nulls_first())
        links = self.work.put(rows.mapInArrow(_verify(self.percent), "u long, v long"), f"links-{name}")
        self.work.drop(f"pairs-{name}", f"sets-{name}")
        return links

    def run(self) -> DataFrame:
        members, found, sketch = self.classes()
        shared = self.spark.sparkContext.broadcast(sketch)  # 16 to 64 MB
        del sketch
        reps = found.select(F.col("doc").alias("rep")).distinct()
        made = self.docs.mapInArrow(_prefixes(shared, self.size, self.percent), _PREFIX)
        prefixes = self.work.put(made.join(reps.hint("merge"), made["doc"] == reps["rep"], "left_semi"), "prefixes", codec="lz4")
        shared.destroy()

        posted = prefixes.select("doc", "n", "matches", "cold", F.posexplode("tokens").alias("at", "token"))
        cold = posted.where("at < cold").select("token", "doc", "n", "matches", "at")
        cold = cold.repartition(tables.partitions(self.spark), "token").sortWithinPartitions("token")
        matches = self.work.put(cold.mapInArrow(_pair_up(self.percent), _FOUND), "matches")
        pairs = matches.where("y is not null").groupBy("x", "y", "nx", "ny").agg(
            F.count("*").alias("c"), F.min("px").alias("px"), F.min("py").alias("py"), F.least(F.min("mx"), F.min("my")).alias("asked")
        )
        need = F.ceil(F.lit(self.percent) * (F.col("nx") + F.col("ny")) / F.lit(100 + self.percent) - F.lit(1e-9))
        pairs = pairs.where((F.col("c") >= F.col("asked")) & (F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= need)).select("x", "y")

        hot = matches.where("y is null").select("token", F.col("x").alias("doc"), F.col("nx").alias("n"), F.col("mx").alias("matches"), F.col("px").alias("at"))
        hot = self.work.put(hot.unionByName(posted.where("at >= cold").select("token", "doc", "n", "matches", "at")), "hot")
        centre = hot.groupBy("token").agg(F.min(F.struct("at", "doc")).alias("c")).select("token", F.col("c.doc").alias("y"))
        stars = hot.join(centre, "token").where("doc <> y").select(F.col("doc").alias("x"), "y")
        links = self.verified(pairs.unionByName(stars), "a")
        labels = components(links, self.work, "components-a")
        rest = self.across(hot, prefixes, labels)
        if rest is not None:
            again = self.verified(rest, "b")
            if not again.isEmpty():
                links = links.unionByName(again)
                labels = components(links, self.work, "components-b")
        return self.labelled(members, found, labels)

    def across(self, hot: DataFrame, prefixes: DataFrame, labels: DataFrame) -> DataFrame | None:
        """Pairs under common shingles that lie in different components and may link; None if there are none."""
        # Sets that link differ in size by the asked share at most, so a document meets those of its own band of sizes, where
        # it is at home, and as a guest those of the band below.
        width = max(math.log(100 / self.percent), 1e-6) * (1 + 1e-9)
        named = hot.join(labels, hot["doc"] == labels["node"], "left").select("token", "doc", F.coalesce("component", "doc").alias("comp"), F.floor(F.log("n") / width).cast("int").alias("own"))
        named = named.select("token", "doc", "comp", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("band"), "own").withColumn("home", F.col("own") == F.col("band"))
        per = named.groupBy("token", "band", "comp").agg(F.count("*").alias("count"), F.max("home").alias("home"))
        most = per.groupBy("token", "band").agg(F.max(F.struct("count", "comp")).alias("m"), F.sum("count").alias("total"), F.max("home").alias("home"))
        few = F.col("total") - F.col("m.count")
        most = most.where("home").select("token", "band", F.col("m.comp").alias("major"), F.col("m.count").alias("many"), few.alias("few")).where("few > 0")
        most = self.work.put(most, "unsettled")
        if most.isEmpty():
            return None
        blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        rows = named.join(most, ["token", "band"]).select(
            "token", "band", "doc", "comp", "home", blocks("few").alias("nf"), blocks("many").alias("nm"), (F.col("comp") == F.col("major")).alias("big")
        )
        part = F.pmod(F.xxhash64("doc"), F.when(F.col("big"), F.col("nm")).otherwise(F.col("nf")))
        rows = rows.withColumn("block", (part + F.when(F.col("big"), F.col("nf")).otherwise(0)).cast("int"))
        # Blocks of the major component meet those of the others; the others meet each other as well.
        mates = F.when(F.col("big"), F.sequence(F.lit(0), F.col("nf") - 1)).otherwise(F.sequence(F.lit(0), F.col("nf") + F.col("nm") - 1))
        rows = rows.withColumn("mate", F.explode(mates))
        rows = rows.select("token", "band", "doc", "comp", "home", "block", F.least("block", "mate").alias("i"), F.greatest("block", "mate").alias("j"))
        lists = hot.groupBy("doc").agg(F.sort_array(F.collect_set("token")).alias("hots"))
        about = prefixes.join(lists, "doc").select(F.col("doc").alias("id"), "n", "matches", "tokens", "hots")
        rows = rows.join(about, rows["doc"] == about["id"]).drop("id")
        return self.work.put(rows.groupBy("token", "band", "i", "j").applyInPandas(_blocks(self.percent), "x long, y long").distinct(), "across")

    def labelled(self, members: DataFrame, found: DataFrame, labels: DataFrame) -> DataFrame:
        named = found.join(labels, found["doc"] == labels["node"], "left").select("d1", "d2", F.coalesce("component", "doc").alias("component_id"))
        # Documents without words are in no class; their own ids spread them over the tasks.
        members = members.withColumn("d1", F.when(F.col("n") == 0, F.xxhash64("doc_id")).otherwise(F.col("d1")))
        joined = members.join(named, ["d1", "d2"], "left")
        own = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document.

    Two documents link when 100 * intersection >= percent * union of their sets of `size`-word shingles, A-Z in lower
    case.  With fewer words the whole sequence is one shingle; null and empty texts have none and link with nothing.
    Rows that share a doc_id are one document with several texts, linked if any of these are; repeated rows keep their
    rows.  A row without a doc_id keeps its size and has no component, and links with nothing.  Very long texts are one set
    each, held alone in a task.  An empty table gives no rows; columns other than doc_id and text are not read.
    """
    return Join(docs, size, percent).run()
