"""Input tables, and tables written between the jobs of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace

__all__ = ["Workspace", "bound_batches", "load", "partitions", "texts"]


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python are bounded by bytes, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, whatever else the table holds."""
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
