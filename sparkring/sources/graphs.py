"""Graphs in the tables of a star schema."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs made at once.
PAIRS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copart(spark: SparkSession, sf_dir: str, least_quantity: float | None = None) -> DataFrame:
    """Parts that share an order; both directions, each edge once."""
    lines = table(spark, sf_dir, "lineitem")
    if least_quantity is not None:
        lines = lines.where(F.col("l_quantity") >= least_quantity)
    a = lines.select("l_orderkey", F.col("l_partkey").alias("src"))
    b = lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").where("src <> dst").select("src", "dst").distinct()


def pairs(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Members of one group: (src, dst) with dst < src, made in order of group; a pair of several groups is there several times."""
    known = rows.select(F.col(group).cast("long").alias("g"), F.col(member).cast("long").alias("m")).where("g is not null and m is not null")
    return known.repartition("g").sortWithinPartitions("g").mapInArrow(_pairs, "src long, dst long")


def copart_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower triangle of `copart`, in which an edge is repeated for each order that both parts share."""
    return pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, member) in order of group -> each two different members of a group, the larger one first."""
    group = member = np.zeros(0, np.int64)
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            group, member = (np.append(x, c.to_numpy(zero_copy_only=False)) for x, c in zip((group, member), batch.columns, strict=True))
        last = len(group) if batch is None or not len(group) else int(np.searchsorted(group, group[-1]))
        start = np.searchsorted(group[:last], group[:last])
        before = np.arange(last) - start
        done, at = np.cumsum(before), 0
        while at < last:
            end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
            n = before[at:end]
            x = np.repeat(member[at:end], n)
            y = member[np.repeat(start[at:end] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            at, two = end, x != y
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)[two]), pa.array(np.minimum(x, y)[two])], names=["src", "dst"])
        group, member = group[last:], member[last:]


def custsupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the suppliers of their orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("dst"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("src", "dst").distinct()


def supppart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def nationtrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers and of the suppliers they buy from."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("cn"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_nationkey").cast("long").alias("sn"))
    return custsupp(spark, sf_dir).join(customers, "src").join(suppliers, "dst").select(F.col("cn").alias("src"), F.col("sn").alias("dst")).distinct()


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"))
