"""Element-wise operations, assignment, gather, scatter and reductions of sparse vectors and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """OR of two sets."""
    return a.select("v").unionByName(b.select("v")).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """AND NOT of two sets."""
    return a.select("v").join(b.select("v"), "v", "left_anti")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("v").join(b.select("v"), "v", "left_semi").distinct()


def union_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """OR of packed sets (blk, word)."""
    return a.unionByName(b).groupBy("blk").agg(F.bit_or("word").alias("word"))


def minus_words(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select("blk", F.col("word").alias("gone"))
    left = a.join(other, "blk", "left").select("blk", F.col("word").bitwiseAND(F.bitwise_not(F.coalesce("gone", F.lit(0)))).alias("word"))
    return left.where("word <> 0")


def _both(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    left = a.select(F.col("v").alias("va"), F.col("val").alias("a"))
    right = b.select(F.col("v").alias("vb"), F.col("val").alias("b"))
    return left.join(right, F.col("va") == F.col("vb"), how).select(F.coalesce("va", "vb").alias("v"), "a", "b")


def minimum(a: DataFrame, b: DataFrame) -> DataFrame:
    """Smaller of two values; an absent one counts as infinite."""
    return _both(a, b, "full_outer").select("v", F.least("a", "b").alias("val"))


def less(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 where a < b, else 0; an absent value is infinite."""
    return _both(a, b, "full_outer").select("v", F.when(F.col("a").isNull(), 0).when(F.col("b").isNull(), 1).otherwise((F.col("a") < F.col("b")).cast("int")).alias("val"))


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 where the values differ, else 0; absent equals absent alone."""
    return _both(a, b, "full_outer").select("v", (~F.col("a").eqNullSafe(F.col("b"))).cast("int").alias("val"))


def add_value(a: DataFrame, value: float) -> DataFrame:
    return a.select("v", (F.col("val") + F.lit(value)).alias("val"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, "inner").select("v", (F.col("a") - F.col("b")).alias("val"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, "inner").select("v", (F.col("a") * F.col("b")).alias("val"))


def keep_where(a: DataFrame, mask: DataFrame) -> DataFrame:
    """Values outside the mask (v, val = 0) become infinite, that is absent."""
    return a.join(mask.where("val <> 0").select("v"), "v", "left_semi")


def fill(domain: DataFrame, value: int | float) -> DataFrame:
    return domain.select("v", F.lit(value).alias("val"))


def iota(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("v"), F.col("id").alias("val"))


def set_element(a: DataFrame, v: int, value: int | float) -> DataFrame:
    return a.select("v", F.when(F.col("v") == v, F.lit(value)).otherwise(F.col("val")).alias("val"))


def gather(values: DataFrame, index: DataFrame) -> DataFrame:
    """out[i] = values[index[i]]; index: (v, val)."""
    at = index.select(F.col("v").alias("i"), F.col("val").alias("at"))
    return at.join(values, at["at"] == values["v"]).select(F.col("i").alias("v"), "val")


def scatter_min(values: DataFrame, index: DataFrame) -> DataFrame:
    """out[index[i]] = values[i]; of several values for one place the smallest stays."""
    at = index.select(F.col("v").alias("i"), F.col("val").alias("at"))
    return at.join(values, at["i"] == values["v"]).groupBy(F.col("at").alias("v")).agg(F.min("val").alias("val"))


def popcount_words(words: DataFrame) -> DataFrame:
    """Members of a packed set, as one row (total)."""
    return words.agg(F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).cast("long").alias("total"))


def total(a: DataFrame, value: Column | str = "val") -> DataFrame:
    return a.agg(F.sum(value).alias("total"))


def total_finite(a: DataFrame, infinity: int) -> DataFrame:
    """The sum of the values below a stand-in for infinity."""
    return a.agg(F.sum(F.when(F.col("val") < infinity, F.col("val"))).alias("total"))


def masked_total(matrix: DataFrame, mask: DataFrame) -> DataFrame:
    """The sum of a matrix (src, dst, val) at the places of the mask."""
    return matrix.join(mask.select("src", "dst"), ["src", "dst"], "left_semi").agg(F.coalesce(F.sum("val"), F.lit(0)).cast("long").alias("total"))


def l2_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Length of the difference; an absent value is 0."""
    d = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return _both(a, b, "full_outer").agg(F.sqrt(F.coalesce(F.sum(d * d), F.lit(0.0))).alias("l2"))


def nonzeros(a: DataFrame) -> DataFrame:
    return a.agg(F.count_if(F.col("val") != 0).alias("nnz"))


def distinct_labels(a: DataFrame) -> DataFrame:
    return a.agg(F.countDistinct("val").alias("labels"))


def load_report(loads: DataFrame) -> DataFrame:
    """Least, most, mean, population deviation, and the place of the most, of (unit, load); ties go to the larger unit."""
    return loads.agg(
        F.min("load").alias("least"),
        F.max("load").alias("most"),
        F.avg("load").alias("mean"),
        F.stddev_pop("load").alias("deviation"),
        F.max(F.struct("load", "unit"))["unit"].alias("busiest"),
    )


def top(a: DataFrame, k: int) -> DataFrame:
    """The k largest values, ties to the smaller vertex."""
    return a.orderBy(F.desc("val"), "v").limit(k)
