"""Tables written between the jobs of an iteration, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on one machine (tests), a new temporary one.

    Executors of a cluster would not see such a folder, so there the setting must be made.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[[\d*, ]+\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


class Clustered:
    """Edges in buckets, and what a vector needs to meet them without moving them."""

    def __init__(self, spark: SparkSession, table: str, hubs: DataFrame):
        self.spark, self.table, self.hubs = spark, table, hubs

    def joined(self, x: DataFrame) -> DataFrame:
        """Each edge with the vector's row at its src; a hub's row meets each of its parts."""
        dealt = x.join(F.broadcast(self.hubs), x["v"] == F.col("hub"), "left")
        dealt = dealt.withColumn("at", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("hub", "parts")
        edges = self.spark.table(self.table)
        return edges.join(dealt, (edges["src"] == dealt["v"]) & (edges["part"] == dealt["at"])).drop("part", "at")

    def forget(self) -> None:
        """Take the table out of the catalog; its files stay in the workspace."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


class Workspace:
    """Written tables cut the lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, codec: str = "zstd", mode: str = "overwrite") -> DataFrame:
        self.sweep()
        df.write.mode(mode).option("compression", codec).parquet(self.path(name))
        self.sweep()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def sweep(self) -> None:
        """Shuffle files of ended jobs go when the driver collects its garbage, those of the last job often only when the next begins."""
        self.spark._jvm.System.gc()

    def clustered(self, edges: DataFrame, name: str, least: int = 10_000) -> Clustered:
        """Edges (src, ...) written once in buckets by src, so that the rounds of an iteration shuffle only what they carry.

        A vertex with more edges than a quarter of a bucket's even share (and `least`) is a hub: its edges are dealt over several parts,
        which are buckets of their own.  There are fewer than four hubs for each bucket, so their table may be copied.
        """
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        edges = self.put(edges, f"{name}-plain")
        share = max(least, -(-edges.count() // (4 * buckets)))
        degree = edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > share)
        hubs = self.put(degree.select(F.col("src").alias("hub"), F.ceil(F.col("n") / share).cast("int").alias("parts")), f"{name}-hubs")
        dealt = edges.join(F.broadcast(hubs), F.col("src") == F.col("hub"), "left")
        part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")
        dealt = dealt.select(*edges.columns, part.alias("part")).repartition(buckets, "src", "part")
        table = f"{name}_{uuid.uuid4().hex}"
        dealt.write.format("parquet").bucketBy(buckets, "src", "part").option("path", self.path(name)).saveAsTable(table)
        self.drop(f"{name}-plain")
        return Clustered(self.spark, table, hubs)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing lazy still reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
