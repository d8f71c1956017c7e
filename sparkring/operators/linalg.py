"""Products over semirings: matrix by vector, matrix by matrix, with masks; on edges, or on packed tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import block
from ..functions.semiring import COUNTING, Semiring
from ..schema import check_width
from ..workspace import Workspace
from . import blocks, prep, tiles

#: A vector of at most so many rows may be copied to every executor; above that both sides are dealt out by key.
STAGED_ROWS = 1_000_000


def staged(vector: DataFrame, rows: int = STAGED_ROWS) -> DataFrame:
    """The vector marked for copying to every executor, if it is counted to be small enough."""
    return F.broadcast(vector) if vector.limit(rows + 1).count() <= rows else vector


def _weight(edges: DataFrame):
    return F.col("weight") if "weight" in edges.columns else F.lit(1)


def mxv(edges: DataFrame, x: DataFrame, semiring: Semiring = COUNTING) -> DataFrame:
    """y[i] = sum over j of A[i, j] * x[j]: (v, val) of the rows with a product."""
    value = F.col("val") if "val" in x.columns else F.lit(1)
    product = edges.join(x, edges["dst"] == x["v"]).select(F.col("src").alias("row"), semiring.multiply(_weight(edges), value).alias("product"))
    return product.groupBy(F.col("row").alias("v")).agg(semiring.add(F.col("product")).alias("val"))


def vxm(x: DataFrame, edges: DataFrame, semiring: Semiring = COUNTING) -> DataFrame:
    """y[j] = sum over i of x[i] * A[i, j]."""
    value = F.col("val") if "val" in x.columns else F.lit(1)
    product = edges.join(x, edges["src"] == x["v"]).select(F.col("dst").alias("row"), semiring.multiply(_weight(edges), value).alias("product"))
    return product.groupBy(F.col("row").alias("v")).agg(semiring.add(F.col("product")).alias("val"))


def masked(vector: DataFrame, mask: DataFrame, complement: bool = False) -> DataFrame:
    """Entries inside (or with complement outside) a set (v)."""
    return vector.join(mask.select("v"), "v", "left_anti" if complement else "left_semi")


def mxv_bool(edges: DataFrame, x: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """The set of out-neighbours of a set, less the mask: one step of a search.

    Distinct comes before the mask, so the anti join sees each vertex once.
    """
    reached = edges.join(x.select("v"), edges["src"] == F.col("v")).select(F.col("dst").alias("v")).distinct()
    return reached if mask is None else masked(reached, mask, complement=True)


def mxv_packed(matrix: DataFrame, words: DataFrame, width: int = 32) -> DataFrame:
    """Counting product of row tiles and a packed set: AND and population count."""
    joined = matrix.join(words, matrix["bcol"] == words["blk"]).select("brow", "r", F.bit_count(matrix["word"].bitwiseAND(words["word"])).alias("bits"))
    row = F.expr(f"brow * {width} + r").alias("v")
    return joined.where("bits > 0").groupBy(row).agg(F.sum("bits").cast("long").alias("val"))


def mxv_bool_packed(matrix: DataFrame, words: DataFrame, mask: DataFrame | None = None, width: int = 32) -> DataFrame:
    """Boolean product of row tiles and a packed set, less a packed mask: (blk, word) of the rows that meet the set.

    A row's bit is set if its word and the set's share a bit; rows of a block are put together, then the mask's bits go.
    """
    met = matrix.join(words.select("blk", F.col("word").alias("x")), matrix["bcol"] == F.col("blk")).where(F.col("word").bitwiseAND(F.col("x")) != 0)
    rows = met.groupBy(F.col("brow").alias("blk")).agg(F.bit_or(F.expr(f"shiftleft(1L, {width - 1} - r)")).alias("word"))
    if mask is None:
        return rows
    known = mask.select(F.col("blk").alias("known"), F.col("word").alias("m"))
    left = rows.join(known, rows["blk"] == F.col("known"), "left")
    return left.select("blk", F.expr("word & ~coalesce(m, 0L)").alias("word")).where("word <> 0")


def mxv_values_packed(matrix: DataFrame, blocks: DataFrame, semiring: Semiring, width: int = 32, weight: Column | None = None) -> DataFrame:
    """(v, val): product over a semiring of row tiles, all of whose entries have one weight (1), and a vector by blocks.

    The values at a row's set bits are added up within the tile; only one value for each row of a tile is shuffled.
    """
    one = F.lit(1) if weight is None else weight
    joined = matrix.join(blocks, matrix["bcol"] == blocks["blk"])
    hits = F.filter("items", lambda x: F.col("word").bitwiseAND(x["bit"]) != 0)
    joined = joined.select("brow", "r", hits.alias("hits")).where(F.size("hits") > 0)
    part = semiring.fold(F.transform("hits", lambda x: semiring.multiply(one, x["val"])))
    return joined.groupBy(F.expr(f"brow * {width} + r").alias("v")).agg(semiring.merge(part).alias("val"))


def _renamed(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col("src").alias(src), F.col("dst").alias(dst))


def mxm(a: DataFrame, b: DataFrame, once: bool = False) -> DataFrame:
    """(src, dst, val): how many paths lead from i over A's and B's edges to k.  once, here and below: a repeated edge counts once."""
    return blocks.product(a, b, "count", once)


def mxm_bool(a: DataFrame, b: DataFrame) -> DataFrame:
    return blocks.product(a, b, "bool", once=True)


def mxm_weighted(a: DataFrame, b: DataFrame, once: bool = False) -> DataFrame:
    """Values multiplied and added up in double precision."""
    left, right = (x.select("src", "dst", _weight(x).cast("double").alias("weight")) for x in (a, b))
    return blocks.product(left, right, "weighted", once)


def mxm_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of all entries of the counting product, as one row (total).

    Degrees are multiplied instead of pairs being made: the sum over j of A's in-degree and B's out-degree.
    """
    into = a.groupBy(F.col("dst").alias("j")).agg(F.count("*").alias("n"))
    out = b.groupBy(F.col("src").alias("j")).agg(F.count("*").alias("m"))
    return into.join(out, "j").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).cast("long").alias("total"))


def mxm_sum_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same sum by the join itself."""
    return _renamed(a, "i", "j").join(_renamed(b, "j", "k"), "j").agg(F.count("*").alias("total"))


def mxm_sum_packed(a: DataFrame, b: DataFrame, width: int = 32) -> DataFrame:
    """The same sum on tiles: bits of A's row tiles and of B's column tiles counted by block, and multiplied place by place."""
    cols = tiles.column_counts(tiles.pack(a, width), width)
    flipped = tiles.pack(b, width, by="col").select(F.col("bcol").alias("brow"), F.col("brow").alias("bcol"), "r", "word")
    rows = tiles.column_counts(flipped, width).select("blk", F.col("counts").alias("more"))
    dot = F.reduce(F.zip_with("counts", "more", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    return cols.join(rows, "blk").agg(F.coalesce(F.sum(dot), F.lit(0)).cast("long").alias("total"))


def mxm_masked(a: DataFrame, b: DataFrame, mask: DataFrame, once: bool = False) -> DataFrame:
    """Counting product at the places of the mask only.  once, here and below: an edge or place that is repeated counts once.

    No other entry is made; each place walks along the shorter one of A's row and B's column, and looks the other edge up, so that
    hubs are not walked along from every neighbour.
    """
    return blocks.masked_counts(a, b, mask, once)


def mxm_masked_sum(a: DataFrame, b: DataFrame, mask: DataFrame, once: bool = False) -> DataFrame:
    return blocks.masked_total(a, b, mask, 0, once)


def mxm_masked_sum_packed(a: DataFrame, b: DataFrame, mask: DataFrame, width: int = 64, once: bool = False) -> DataFrame:
    """The masked sum on packed rows of A and columns of B: for each masked place, AND and population count by block."""
    return blocks.masked_total(a, b, mask, check_width(width), once)


def mxm_masked_corners(a: DataFrame, b: DataFrame, mask: DataFrame, once: bool = False) -> DataFrame:
    """(v, n): of how many terms A[i, j] * B[j, k] of the masked product each vertex is i, j or k."""
    return blocks.masked_corners(a, b, mask, once)


def mxm_symbolic(a: DataFrame, b: DataFrame, width: int = 32) -> DataFrame:
    """(brow, tiles): the product's tiles in each block row that its factors' tile pattern allows.

    The tile patterns' boolean product, block against block; its entries are counted where they are met, and only those around the
    ends of ranges leave as words of 64, which are put together by OR.
    """
    work = Workspace(a.sparkSession, "symbolic")
    alike = prep.transpose(a).sameSemantics(b)
    left, *other = (work.put(x.select(block("src", width).alias("src"), block("dst", width).alias("dst")).distinct(), name) for x, name in ((a, "a"), (b, "b"))[: 2 - alike])
    right = prep.transpose(left) if alike else other[0]
    return blocks.product_sizes(left, right).select(F.col("src").alias("brow"), F.col("n").alias("tiles"))


def dense_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Boolean product of dense 0/1 matrices (i, j, value): the set entries, thresholded above 0."""
    left = a.where("value > 0").select("i", "j")
    right = b.where("value > 0").select(F.col("i").alias("j"), F.col("j").alias("k"))
    return left.join(right, "j").select("i", F.col("k").alias("j")).distinct().withColumn("value", F.lit(1))
