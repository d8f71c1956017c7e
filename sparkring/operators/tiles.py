"""The packed form: square tiles whose rows are words of bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import bit_of, block, test_bit
from ..schema import check_width

#: Bytes of a packed row in storage: widths 4 and 8 take a byte.
WORD_BYTES = {4: 1, 8: 1, 16: 2, 32: 4, 64: 8}


def pack(edges: DataFrame, width: int = 32, by: str = "row") -> DataFrame:
    """Tiles (brow, bcol, r, word).  by="row": word r holds row r; by="col": word r holds column r."""
    check_width(width)
    if by not in ("row", "col"):
        raise ValueError("by must be row or col")
    line, bit = ("src", "dst") if by == "row" else ("dst", "src")
    return edges.groupBy(block("src", width).alias("brow"), block("dst", width).alias("bcol"), F.expr(f"cast({line} % {width} as int)").alias("r")).agg(
        F.bit_or(bit_of(bit, width)).alias("word")
    )


def unpack(tiles: DataFrame, width: int = 32, by: str = "row") -> DataFrame:
    """The edges of the set bits."""
    check_width(width)
    bits = tiles.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bit")).where(test_bit("word", "bit", width))
    row, col = ("r", "bit") if by == "row" else ("bit", "r")
    return bits.select(F.expr(f"brow * {width} + {row}").alias("src"), F.expr(f"bcol * {width} + {col}").alias("dst"))


def pack_set(members: DataFrame, width: int = 32) -> DataFrame:
    """A set (v) as words (blk, word)."""
    check_width(width)
    return members.groupBy(block("v", width).alias("blk")).agg(F.bit_or(bit_of("v", width)).alias("word"))


def unpack_set(words: DataFrame, width: int = 32, keep: tuple[str, ...] = ()) -> DataFrame:
    """The members (v) of the words, with other columns of their words."""
    check_width(width)
    bits = words.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bit")).where(test_bit("word", "bit", width))
    return bits.select(F.expr(f"blk * {width} + bit").alias("v"), *keep)


def pack_values(x: DataFrame, width: int = 32) -> DataFrame:
    """A vector (v, val) by blocks: (blk, items), items being (bit, value) pairs, at most `width` of them."""
    check_width(width)
    item = F.struct(bit_of("v", width).alias("bit"), F.col("val").alias("val"))
    return x.groupBy(block("v", width).alias("blk")).agg(F.collect_list(item).alias("items"))


def column_counts(tiles: DataFrame, width: int = 32) -> DataFrame:
    """(blk, counts) of row tiles: how many rows have each bit of a block column set."""
    check_width(width)
    ones = [F.sum(F.expr(f"shiftrightunsigned(word, {width - 1 - p}) & 1L")).alias(f"n{p}") for p in range(width)]
    return tiles.groupBy(F.col("bcol").alias("blk")).agg(*ones).select("blk", F.array(*(f"n{p}" for p in range(width))).alias("counts"))


def align(tiles: DataFrame, width: int = 8, to: int = 32) -> DataFrame:
    """Fuse to / width neighbouring tiles of a block row into words of width `to`: (brow, slot, r, word).

    Tiles of a block row are taken in column order; the first one is in the highest bits.
    """
    check_width(width), check_width(to)
    per = to // width
    order = Window.partitionBy("brow").orderBy("bcol")
    numbered = tiles.select("brow", "bcol").distinct().select("brow", "bcol", (F.row_number().over(order) - 1).alias("k"))
    at = numbered.select("brow", "bcol", F.expr(f"k div {per}").alias("slot"), F.expr(f"cast({to - width} - (k % {per}) * {width} as int)").alias("shift"))
    return tiles.join(at, ["brow", "bcol"]).groupBy("brow", "slot", "r").agg(F.bit_or(F.expr("shiftleft(word, shift)")).alias("word"))


def repack(tiles: DataFrame, width: int, to: int) -> DataFrame:
    """The same matrix in tiles of another width."""
    return pack(unpack(tiles, width), to)


def expand_pointers(pointers: DataFrame) -> DataFrame:
    """(brow, start, end) -> one row (brow, at) for each tile's place: explicit block rows from row pointers."""
    return pointers.where("end > start").select("brow", F.explode(F.expr("sequence(start, end - 1)")).alias("at"))


def tile_count(edges: DataFrame, width: int) -> DataFrame:
    return edges.select(block("src", width).alias("brow"), block("dst", width).alias("bcol")).distinct().agg(F.count("*").alias("tiles"))


def occupancy(edges: DataFrame, rows: int, widths: tuple[int, ...] = (4, 8, 16, 32, 64)) -> DataFrame:
    """(width, tiles, percent): how many tiles are not empty, in one pass over the edges' tile names."""
    spark = edges.sparkSession
    named = edges.select(F.explode(F.array(*(F.struct(F.lit(b).alias("width"), block("src", b).alias("brow"), block("dst", b).alias("bcol")) for b in widths))).alias("t"))
    counts = named.select("t.*").distinct().groupBy("width").agg(F.count("*").alias("tiles"))
    sizes = spark.createDataFrame([(b, -(-rows // b)) for b in widths], "width int, side long")
    return counts.join(F.broadcast(sizes), "width").select("width", "tiles", (100.0 * F.col("tiles") / (F.col("side") * F.col("side"))).alias("percent"))


def footprint(edges: DataFrame, rows: int, widths: tuple[int, ...] = (4, 8, 16, 32, 64)) -> DataFrame:
    """(width, csr_bytes, bsr_bytes) with 4-byte indices and values."""
    spark = edges.sparkSession
    sizes = spark.createDataFrame([(b, -(-rows // b), b * WORD_BYTES[b]) for b in widths], "width int, side long, tile_bytes long")
    nnz = edges.agg(F.count("*").alias("nnz"))
    return (
        occupancy(edges, rows, widths)
        .join(F.broadcast(sizes), "width")
        .join(F.broadcast(nnz))
        .select(
            "width",
            ((F.lit(rows + 1) + 2 * F.col("nnz")) * 4).alias("csr_bytes"),
            (F.col("tiles") * F.col("tile_bytes") + (F.col("side") + 1 + F.col("tiles")) * 4).alias("bsr_bytes"),
        )
    )


def readable(size: int) -> str:
    """Bytes in a unit that keeps the number short."""
    number, units = float(size), ["B", "KB", "MB", "GB", "TB", "PB"]
    while number >= 1024 and len(units) > 1:
        number /= 1024
        units.pop(0)
    return f"{number:.2f} {units[0]}"
