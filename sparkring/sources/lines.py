"""Numbered rows of one text file, read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_INSIDE = (1 << 33) - 1


def numbered(rows: DataFrame, name: str = "k") -> DataFrame:
    """Rows of one file with their place from 0 on.  Splits of one file are read in their order, so a row's place is what
    the partitions before its own hold, and its place there; no task sees all rows."""
    own = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.expr("shiftright(_at, 33)"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    counts = own.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + F.expr(f"_at & {_INSIDE}L")).drop("_at", "_part", "_before")
