"""PageRank by plus-times products, without redistribution from vertices that have no out-edge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prep
from ..workspace import Workspace

ALPHA, EPSILON, MAX_ROUNDS = 0.85, 1e-9, 10


@dataclass
class Ranks:
    ranks: DataFrame  # (v, rank)
    rounds: int
    error: float  # of the last round


def pagerank(edges: DataFrame, vertices: DataFrame, alpha: float = ALPHA, epsilon: float = EPSILON, max_rounds: int = MAX_ROUNDS) -> Ranks:
    """Ranks of the vertices (v); degrees count the edges as given, repeated ones and loops included.

    Stops when the length of the change is at most epsilon, or after `max_rounds`.
    """
    work = Workspace(edges.sparkSession, "pagerank")
    domain = work.put(vertices.select("v").distinct(), "vertices")
    n = domain.count()
    if not n:
        return Ranks(domain.withColumn("rank", F.lit(0.0)), 0, 0.0)
    degree = prep.out_degree(edges).withColumnRenamed("v", "src")
    shares = work.clustered(edges.select("src", "dst").join(degree, "src").select("src", "dst", (F.lit(alpha) / F.col("degree")).alias("share")), "shares")
    ranks = domain.withColumn("rank", F.lit(1.0 / n))
    rounds, error = 0, float("inf")
    while error > epsilon and rounds < max_rounds:
        rounds += 1
        got = shares.joined(ranks).groupBy(F.col("dst").alias("u")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = ranks.join(got, ranks["v"] == got["u"], "left").select("v", (F.coalesce("got", F.lit(0.0)) + (1 - alpha) / n).alias("next"), "rank")
        new = work.put(new, f"ranks-{rounds}")
        error = float(new.agg(F.sqrt(F.sum(F.pow(F.col("next") - F.col("rank"), 2))).alias("e")).first()["e"])
        if rounds > 1:
            work.drop(f"ranks-{rounds - 1}")
        ranks = new.select("v", F.col("next").alias("rank"))
    shares.forget()
    return Ranks(ranks, rounds, error)
