"""Preparation of edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import block


def rebase(edges: DataFrame, by: int = 1) -> DataFrame:
    """Ids that begin at `by` become 0-based."""
    return edges.withColumns({"src": F.col("src") - by, "dst": F.col("dst") - by})


def transpose(edges: DataFrame) -> DataFrame:
    """A swap of columns; no data moves."""
    swap = {"src": "dst", "dst": "src"}
    return edges.select(*(F.col(swap.get(c, c)).alias(c) for c in edges.columns))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, without duplicates."""
    pairs = edges.select("src", "dst")
    return pairs.unionByName(transpose(pairs)).distinct()


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


zero_diagonal = drop_loops


def dedupe(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst"])


def pattern(edges: DataFrame) -> DataFrame:
    """Values are forgotten: every edge counts as 1."""
    return edges.select("src", "dst")


def tril(edges: DataFrame) -> DataFrame:
    """The lower triangle, diagonal included."""
    return edges.where("dst <= src")


def ordered(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst")


def clean(edges: DataFrame, directed: bool = True, drop_self_loops: bool = True) -> DataFrame:
    """What graph algorithms take: mirrored if undirected, without loops, each edge once."""
    out = edges.select("src", "dst")
    if drop_self_loops:
        out = drop_loops(out)
    return symmetrize(out) if not directed else out.distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v"))).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return out_degree(edges).groupBy("degree").agg(F.count("*").alias("n"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Sorted neighbour lists.  A hub's list is one row: for display and small degrees; joins work on the edges."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))


def running(rows: DataFrame, key: str, value: str, name: str, buckets: int = 4096) -> DataFrame:
    """The rows with the sum of `value` over all rows of a smaller `key` (distinct, not negative).

    Two levels: sums over ranges of keys, of which there are `buckets` at most, then within each range, so that no task
    sees all rows.
    """
    top = rows.agg((F.max(key) + 1).alias("_top"))
    width = F.greatest(F.lit(1), F.ceil(F.col("_top") / buckets))
    ranged = rows.join(F.broadcast(top), how="left").withColumn("_range", F.floor(F.col(key) / width)).drop("_top")
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_offset")
    return ranged.join(offsets, "_range").withColumn(name, start.cast("long")).drop("_range", "_offset")


def row_pointers(edges: DataFrame, buckets: int = 4096) -> DataFrame:
    """(v, start, degree) of every vertex with an edge: the exclusive prefix sum of degrees in id order."""
    return running(out_degree(edges), "v", "degree", "start", buckets).select("v", "start", "degree")


def block_row_counts(edges: DataFrame, width: int) -> DataFrame:
    """Non-zeros in each block of `width` rows."""
    return edges.groupBy(block("src", width).alias("brow")).agg(F.count("*").alias("nnz"))


def every(domain: DataFrame, keep: Column) -> DataFrame:
    """The set of vertices where a predicate holds: a bit vector from a rule."""
    return domain.where(keep).select("v")
