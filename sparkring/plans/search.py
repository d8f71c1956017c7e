"""Breadth-first search and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linalg, prep, tiles, vector
from ..workspace import Workspace

MAX_ROUNDS = 10_000
MAX_PARTS = 16


def bfs(edges: DataFrame, source: int = 0, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, list[int]]:
    """(v, level) of the vertices that the source reaches along edges, and the number of new vertices in each round.

    The last count is 0 unless the rounds run out, as the round that finds nothing ends the search.
    """
    spark = edges.sparkSession
    work = Workspace(spark, "bfs")
    edges = work.clustered(edges.select("src", "dst"), "edges")  # every round reads them
    frontier = spark.createDataFrame([(int(source),)], "v long")
    visited = work.put(frontier.withColumn("level", F.lit(0)), "level-0")
    parts, counts = ["level-0"], []
    for depth in range(1, max_rounds + 1):
        reached = edges.joined(frontier).select(F.col("dst").alias("v")).distinct()
        new = linalg.masked(reached, visited.select("v"), complement=True)
        new = work.put(new.withColumn("level", F.lit(depth)), f"level-{depth}")
        counts.append(new.count())
        if not counts[-1]:
            break
        parts.append(f"level-{depth}")
        frontier = new.select("v")
        visited = visited.unionByName(new)
        if len(parts) == MAX_PARTS:  # many rounds: one table again, so that plans stay short
            visited = work.put(visited, f"visited-{depth}")
            work.drop(*(x for x in parts if x != f"level-{depth}"))
            parts = [f"visited-{depth}"]
    edges.forget()
    return visited, counts


def bfs_packed(edges: DataFrame, source: int = 0, width: int = 32, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, list[int]]:
    """The same search on tiles: each round is a boolean product of the transposed tiles and the packed frontier, masked by
    the packed visited set."""
    spark = edges.sparkSession
    work = Workspace(spark, "bfs-packed")
    matrix = work.put(tiles.pack(prep.transpose(edges.select("src", "dst")), width), "tiles")
    frontier = tiles.pack_set(spark.createDataFrame([(int(source),)], "v long"), width)
    visited = work.put(frontier, "visited-0")
    levels, counts = [work.put(frontier.withColumn("level", F.lit(0)), "levels/at=0")], []
    for depth in range(1, max_rounds + 1):
        new = work.put(linalg.mxv_bool_packed(matrix, frontier, visited, width).withColumn("level", F.lit(depth)), f"levels/at={depth}")
        counts.append(int(vector.popcount_words(new).first()["total"] or 0))
        if not counts[-1]:
            break
        levels.append(new)
        frontier = new.select("blk", "word")
        visited = work.put(vector.union_words(visited, frontier), f"visited-{depth}")
        work.drop(f"visited-{depth - 1}")
    every = spark.read.schema("blk long, word long, level int").parquet(work.path("levels"))
    return tiles.unpack_set(every, width, keep=("level",)), counts


def sssp(edges: DataFrame, source: int = 0, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, int]:
    """(v, dist) of the vertices that the source reaches, by min-plus products, and the rounds run.

    Edges without a weight column have length 1; weights must not be negative.  Only vertices whose distance fell go on.
    """
    spark = edges.sparkSession
    work = Workspace(spark, "sssp")
    has_weight = "weight" in edges.columns
    length = F.col("weight") if has_weight else F.lit(1).cast("long")
    kind = "double" if has_weight else "long"
    lengths = work.clustered(edges.select("src", "dst", length.cast(kind).alias("weight")), "edges")  # every round reads them
    dist = spark.createDataFrame([(int(source),)], "v long").withColumn("val", F.lit(0).cast(kind))
    frontier = dist
    rounds = 0
    while rounds < max_rounds:
        rounds += 1
        step = lengths.joined(frontier).groupBy(F.col("dst").alias("v")).agg(F.min(F.col("val") + F.col("weight")).alias("new"))
        old = dist.select(F.col("v").alias("known"), F.col("val").alias("old"))
        better = step.join(old, step["v"] == old["known"], "left").where("old is null or new < old").select("v", F.col("new").alias("val"))
        better = work.put(better, f"better-{rounds}")
        if better.isEmpty():
            break
        dist = work.put(vector.minimum(dist, better), f"dist-{rounds}")
        work.drop(f"dist-{rounds - 1}", f"better-{rounds - 1}")
        frontier = better
    lengths.forget()
    return dist.select("v", F.col("val").alias("dist")), rounds
