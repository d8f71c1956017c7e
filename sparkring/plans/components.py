"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the smallest of u's neighbourhood, u included."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    near = _to_smallest(down)
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def contract(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, component) of every node of the links (u, v); a component is named by its smallest node.

    Directions do not matter; rows with a null, and links of a node with itself, name no component.  Hubs are safe:
    minima are taken before the shuffle, and the join on a hub's key may be split at run time.
    """
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = work.put(links.where("u is not null and v is not null and u <> v").distinct(), f"{name}-0")
    before, turn = None, 0
    while True:
        turn += 1
        edges = work.put(_small_star(_large_star(edges)), f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def connected_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, val): every vertex with the smallest vertex of its weak component; one without an edge is its own."""
    work = Workspace(edges.sparkSession, "components")
    found = contract(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), work)
    domain = vertices.select("v").distinct()
    return domain.join(found, domain["v"] == found["node"], "left").select("v", F.coalesce("component", "v").alias("val"))
