"""Edge streams: the engine's batch operators over arriving files, and windowed degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, folder: str, schema: str = "src long, dst long, ts timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_degrees(edges: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, v, degree) of out-edges by event time; edges later than the watermark are left out."""
    return edges.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def start(degrees: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = degrees.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
