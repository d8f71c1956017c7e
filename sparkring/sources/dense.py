"""Dense and block matrices in CSV files, and a generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import numbered


def generate(spark: SparkSession, n: int = 32) -> DataFrame:
    """(i, j, value) of an n x n matrix whose first column is 1 and the rest 0."""
    return spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), F.expr(f"id % {n}").alias("j"), F.expr(f"cast(id % {n} = 0 as int)").alias("value"))


def write(matrix: DataFrame, path: str) -> None:
    """One value a line, row by row."""
    matrix.orderBy("i", "j").select(F.col("value").cast("string")).coalesce(1).write.mode("overwrite").text(path)


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """(k, value): the numbers of one file in order, separated by commas or line ends."""
    words = spark.read.text(path).select(F.explode(F.expr(r"filter(split(value, '[,\\s]+'), x -> x <> '')")).alias("x"))
    return numbered(words).select("k", F.col("x").cast("double").alias("value"))


def read(spark: SparkSession, path: str, cols: int) -> DataFrame:
    """(i, j, value) of a dense file."""
    return _numbers(spark, path).select(F.expr(f"cast(k div {cols} as long)").alias("i"), F.expr(f"cast(k % {cols} as long)").alias("j"), "value")


def read_blocks(spark: SparkSession, pointers: str, columns: str, blocks: str, width: int) -> DataFrame:
    """(i, j, value) of a block matrix: row pointers and block columns (each file begins with its count), block values row by row."""
    starts = _numbers(spark, pointers).where("k > 0").select((F.col("k") - 1).alias("brow"), F.col("value").cast("long").alias("start"))
    ends = starts.select((F.col("brow") - 1).alias("brow"), F.col("start").alias("end"))
    rows = starts.join(ends, "brow").where("end > start").select("brow", F.explode(F.expr("sequence(start, end - 1)")).alias("at"))
    cols = _numbers(spark, columns).where("k > 0").select((F.col("k") - 1).cast("long").alias("at"), F.col("value").cast("long").alias("bcol"))
    size = width * width
    values = _numbers(spark, blocks).select(F.expr(f"cast(k div {size} as long)").alias("at"), F.expr(f"k % {size}").alias("cell"), "value")
    joined = rows.join(cols, "at").join(values, "at")
    return joined.select(F.expr(f"brow * {width} + cell div {width}").cast("long").alias("i"), F.expr(f"bcol * {width} + cell % {width}").cast("long").alias("j"), "value")
