"""Triangle counting on undirected edges, both directions present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linalg, prep
from ..workspace import Workspace


def oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the end of smaller degree (ties by id), so that no vertex keeps many out-edges.

    The result is written to the shared folder, since the joins that follow read it several times.
    """
    work = Workspace(edges.sparkSession, "triangles")
    edges = work.put(edges.select("src", "dst"), "edges")
    degree = prep.out_degree(edges)
    half = edges.where("src < dst")
    du, dv = (degree.select(F.col("v").alias(k), F.col("degree").alias(f"d_{k}")) for k in ("src", "dst"))
    known = half.join(du, "src").join(dv, "dst")
    forward = F.col("d_src") <= F.col("d_dst")
    up = known.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("dst"))
    out = work.put(up, "oriented")
    work.drop("edges")
    return out


def _lower(edges: DataFrame) -> DataFrame:
    """The lower triangle without loops, written once; edges may be repeated in it."""
    return Workspace(edges.sparkSession, "triangles").put(prep.tril(prep.drop_loops(edges)).select("src", "dst"), "lower")


def count(edges: DataFrame) -> DataFrame:
    """One row (triangles): the masked sum of L times its transpose at L's places, each of which walks along the shorter row.

    Here and below the lower triangle of the edges is enough, and repeated edges count once.
    """
    lower = _lower(edges)
    return linalg.mxm_masked_sum(lower, prep.transpose(lower), lower, once=True).select(F.col("total").alias("triangles"))


def count_packed(edges: DataFrame, width: int = 64) -> DataFrame:
    """The same by AND and population count of packed rows, the shorter of the two at each place; a hub's row meets few places."""
    lower = _lower(edges)
    return linalg.mxm_masked_sum_packed(lower, prep.transpose(lower), lower, width, once=True).select(F.col("total").alias("triangles"))


def per_vertex(edges: DataFrame) -> DataFrame:
    """(v, triangles) of every vertex in at least one."""
    lower = _lower(edges)
    return linalg.mxm_masked_corners(lower, prep.transpose(lower), lower, once=True).select("v", F.col("n").alias("triangles"))
