"""Comparison of results, and timing."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles


def mismatches(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """How many entries of two vectors differ by more than the tolerance, as one row (errors); absent counts as 0."""
    left = a.select(F.col("v").alias("va"), F.col("val").cast("double").alias("a"))
    right = b.select(F.col("v").alias("vb"), F.col("val").cast("double").alias("b"))
    apart = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))) > tolerance
    return left.join(right, F.col("va") == F.col("vb"), "full_outer").agg(F.count_if(apart).alias("errors"))


def packed_mismatches(words: DataFrame, members: DataFrame, width: int = 32) -> DataFrame:
    """How many members a packed set and a plain one do not share."""
    a, b = tiles.unpack_set(words, width), members.select("v")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("errors"))


def check_components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(errors, components): edges whose ends bear different labels, and how many labels there are."""
    u = labels.select(F.col("v").alias("src"), F.col("val").alias("lu"))
    w = labels.select(F.col("v").alias("dst"), F.col("val").alias("lw"))
    errors = edges.join(u, "src").join(w, "dst").agg(F.count_if(F.col("lu") != F.col("lw")).alias("errors"))
    return errors.join(F.broadcast(labels.agg(F.countDistinct("val").alias("components"))))


@dataclass
class Timer:
    """Seconds of repeated actions."""

    seconds: list[float] = field(default_factory=list)

    def run(self, action: Callable[[], object], times: int = 1) -> object:
        out = None
        for _ in range(times):
            began = time.perf_counter()
            out = action()
            self.seconds.append(time.perf_counter() - began)
        return out

    def report(self) -> dict[str, float]:
        n = len(self.seconds)
        mean = sum(self.seconds) / n
        return {"least": min(self.seconds), "most": max(self.seconds), "mean": mean, "deviation": (sum((x - mean) ** 2 for x in self.seconds) / n) ** 0.5}
