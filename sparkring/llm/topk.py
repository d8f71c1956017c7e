"""Exact top-k search by inner product: columnar branch and bound over quantised vectors.

Candidates lie in vertical layout, one row for each dimension.  Scores are accumulated a block of dimensions at a time;
after each block the survivors are compacted to the (query, candidate) pairs whose score so far plus the most that
the remaining dimensions can add (the product of the remaining norms) still reaches the query's k-th best score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Workspace

BLOCK_DIMS = 16
QUERY_BLOCK = 4096
#: Above this share of surviving pairs, columns are added up whole.
DENSE = 0.02
_CANDIDATES = 512


def quantise(column: pa.Array, scale: int, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the vectors that are whole and finite, as doubles, and their rows.

    Vectors that are null, empty, or hold a null, NaN or infinity take no part, nor those of another size than `dims`
    (by default, the first good vector's).
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(size.sum())).cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls: NaN
    first = np.append(0, np.cumsum(size))
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    good = (size > 0) & (bad[first[1:]] == bad[first[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    if good.any():
        good &= size == (dims or size[good.argmax()])
    rows = np.flatnonzero(good)
    if not len(rows):
        return np.zeros((0, 0)), rows
    take = first[:-1][rows][:, None] + np.arange(size[rows[0]])
    out = np.floor(scale * flat[take])
    if out.size and float(np.abs(out).max()) ** 2 * out.shape[1] >= 2**53:
        raise OverflowError("scores would not be exact")
    return out, rows


def _tails(x: np.ndarray) -> np.ndarray:
    """Norms of what follows each block of dimensions, rounded up; one row a block."""
    squares = np.add.reduceat(x * x, np.arange(0, x.shape[1], BLOCK_DIMS), axis=1)
    after = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1] - squares
    return np.sqrt(after).T * (1 + 1e-12)


class Search:
    """A block of queries, with the k best candidates of each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.k = ids[order], vectors[order], k
        self.tails = _tails(self.vectors)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor[order]
        self.found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, candidate id, score

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for i in range(0, len(ids), _CANDIDATES):
            self._add(ids[i : i + _CANDIDATES], vectors[i : i + _CANDIDATES])

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        tails = _tails(vectors)
        columns = np.ascontiguousarray(vectors.T, dtype=self.kind(vectors))
        queries, floor = self.vectors.astype(columns.dtype, copy=False), (self.floor - 1)[:, None]
        starts = list(range(0, len(columns), BLOCK_DIMS))
        score, here = np.zeros((len(queries), len(ids)), dtype=columns.dtype), np.arange(len(ids))
        # While many pairs are alive, whole columns are added up, and those that no query wants any more are dropped.
        while starts:
            at = starts.pop(0)
            score += queries[:, at : at + BLOCK_DIMS] @ columns[at : at + BLOCK_DIMS, here]
            b = at // BLOCK_DIMS
            alive = score + np.outer(self.tails[b], tails[b][here]) >= floor
            if np.count_nonzero(alive) < DENSE * alive.size:
                break
            wanted = alive.any(axis=0)
            if np.count_nonzero(wanted) < 0.8 * len(here):
                here, score, alive = here[wanted], score[:, wanted], alive[:, wanted]
        query, place = np.nonzero(alive)
        candidate, total = here[place], score[query, place].astype(np.float64)
        own = self.ids[query] != ids[candidate]
        query, candidate, total = query[own], candidate[own], total[own]
        for at in starts:
            for d in range(at, min(at + BLOCK_DIMS, len(columns))):
                total += self.vectors[query, d] * columns[d, candidate]
            b = at // BLOCK_DIMS
            left = total + self.tails[b][query] * tails[b][candidate] >= self.floor[query] - 1
            query, candidate, total = query[left], candidate[left], total[left]
        left = total >= self.floor[query]
        self._keep(query[left], ids[candidate[left]], total[left])

    def kind(self, vectors: np.ndarray) -> type:
        """Single precision where it holds all sums of these integers exactly."""
        most = max(float(np.abs(x).max(initial=0)) for x in (self.vectors, vectors))
        return np.float32 if most * most * vectors.shape[1] < 2**24 else np.float64

    def _keep(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(self.found, (query, ids, score), strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        top = place < self.k
        self.found = [query[top], ids[top], score[top]]


def _seed(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th score: its k-th best among the queries themselves, which are candidates too."""
    own = Search(ids, vectors, k)
    own.add(ids, vectors)
    floor = np.empty(len(ids))
    floor[np.argsort(ids, kind="stable")] = own.floor
    return floor


def _scan(shared, scale: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, floor = shared.value
        own = Search(ids, vectors, k, floor.copy())
        for batch in batches:
            found, rows = quantise(batch.column(1), scale, vectors.shape[1])
            if len(rows):
                own.add(batch.column(0).to_numpy(zero_copy_only=False)[rows], found)
        query, candidate, score = own.found
        yield pa.RecordBatch.from_arrays([pa.array(own.ids[query]), pa.array(candidate), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def _seeded(scale: int, k: int) -> Callable:
    """A block of queries -> the same rows with the bound of each."""

    def run(table: pa.Table) -> pa.Table:
        ids, column = table.column("vec_id").to_numpy(), table.column("embedding")
        found, rows = quantise(column, scale)
        floor = np.full(len(ids), -np.inf)
        if len(rows):
            floor[rows] = _seed(ids[rows], found, k)
        return table.append_column("floor", pa.array(floor))

    return run


def search(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k highest inner products of each row where `queries` holds, against every row with another vec_id.

    Ties go to the smaller vec_id; fewer candidates than k: all.  Rows with a null vec_id, and vectors that are null,
    empty or not finite, take no part; vectors of another size than the query's are no candidates for it.  Components so
    large that sums of products would not be exact are an error.  Repeated rows are candidates each, but a query's own
    vec_id never answers it, and a query's repeated rows ask once (with the smallest of their vectors).  An empty table
    gives no rows; other columns are not read.

    Queries go in blocks of about `query_block`, which are made, and given their first bounds, on the executors and written
    once.  Each block is then broadcast (at most a few megabytes) in one pass over the candidates, in which a task sends at
    most k rows for each query; its answers are written and its broadcast is destroyed before the next one's.
    """
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "topk")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("embedding") > 0)
    asked = rows.where(queries).where(whole).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))  # a hot id is one query
    asked = work.put(asked.withColumn("dims", F.size("embedding")), "asked")
    counts = {r["dims"]: r["count"] for r in asked.groupBy("dims").count().collect()}  # one row a size
    parts = {d: -(-n // query_block) for d, n in counts.items()}
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hashed = F.xxhash64("vec_id")
    block = reduce(lambda c, x: c.when(F.col("dims") == x[0], F.pmod(hashed, F.lit(x[1]))), parts.items(), F).cast("int")
    kind = rows.schema["embedding"].dataType.simpleString()
    seeded = asked.withColumn("block", block).groupBy("dims", "block").applyInArrow(_seeded(scale, k), f"vec_id long, embedding {kind}, dims int, block int, floor double")
    asked = work.put(seeded, "seeded")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for dims, b in [(d, b) for d, n in parts.items() for b in range(n)]:
        own = asked.where((F.col("dims") == dims) & (F.col("block") == b)).toArrow()
        if not own.num_rows:
            continue
        found, at = quantise(own.column("embedding"), scale)
        shared = spark.sparkContext.broadcast((own.column("vec_id").to_numpy()[at], found, own.column("floor").to_numpy()[at]))
        scanned = rows.mapInArrow(_scan(shared, scale, k), "query_id long, vec_id long, score long")
        ranked = scanned.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        work.put(ranked, f"found/of={dims}-{b}")
        shared.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(work.path("found")).select("query_id", "rank", "vec_id", "score")
