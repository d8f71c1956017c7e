"""Even work from uneven rows: descriptors (unit, brow, start, load), and aggregation in two phases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prep


def split(loads: DataFrame, most: int) -> DataFrame:
    """Rows (brow, load) cut into pieces (brow, start, load) of at most `most`; rows without load go."""
    pieces = loads.where("load > 0").select("brow", F.col("load").alias("all"), F.explode(F.expr(f"sequence(0L, (load - 1) div {most})")).alias("k"))
    return pieces.select("brow", (F.col("k") * most).alias("start"), F.least(F.lit(most), F.col("all") - F.col("k") * most).cast("long").alias("load"))


def _packed(most: int, cut: bool):
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, room = 0, most
        for part in rows:
            out = []
            for brow, load in zip(part["brow"], part["load"], strict=True):
                start, left = 0, int(load)
                while left:
                    if room == 0 or not cut and left > room and room < most:
                        unit, room = unit + 1, most
                    take = min(left, room) if cut else left
                    out.append((unit, brow, start, take))
                    start, left, room = start + take, left - take, max(0, room - take)
            yield pd.DataFrame(out, columns=["unit", "brow", "start", "load"])

    return run


_UNITS = "unit long, brow long, start long, load long"


def merge(loads: DataFrame, most: int) -> DataFrame:
    """Consecutive rows fused to units of at most `most`; a longer row is a unit alone.

    The packing is sequential by definition: it runs in one task, over one small row for each block row, streamed in
    order and never gathered; what makes the rows runs in as many tasks as before.
    """
    return loads.where("load > 0").repartition(1).sortWithinPartitions("brow").mapInPandas(_packed(most, cut=False), _UNITS)


def merge_split(loads: DataFrame, most: int) -> DataFrame:
    """Consecutive rows in units of exactly `most` (the last one less): what is left of a cut row goes on to the next unit.

    Cuts depend on prefix sums alone, so no sequential pass is needed.
    """
    placed = prep.running(loads.where("load > 0").select("brow", F.col("load").cast("long").alias("all")), "brow", "all", "before")
    cuts = placed.select("brow", "all", "before", F.explode(F.expr(f"sequence(before div {most}, (before + all - 1) div {most})")).alias("unit"))
    start = F.greatest(F.lit(0), F.col("unit") * most - F.col("before"))
    stop = F.least(F.col("all"), (F.col("unit") + 1) * most - F.col("before"))
    return cuts.select("unit", "brow", start.cast("long").alias("start"), (stop - start).cast("long").alias("load"))


def unit_offsets(units: DataFrame) -> DataFrame:
    """(unit, start, end) of each unit's list of two words and one for each member, one list after another."""
    sizes = units.groupBy("unit").agg((F.count("*") + 2).alias("size"))
    return prep.running(sizes, "unit", "size", "start").select("unit", "start", (F.col("start") + F.col("size")).alias("end"))


def salted_count(edges: DataFrame, x: DataFrame, salts: int = 16) -> DataFrame:
    """Counting product with each row's work dealt over `salts` tasks and added up again."""
    pieces = edges.join(x.select("v"), edges["dst"] == F.col("v")).groupBy("src", F.pmod(F.xxhash64("dst"), F.lit(salts)).alias("salt")).agg(F.count("*").alias("part"))
    return pieces.groupBy(F.col("src").alias("v")).agg(F.sum("part").alias("val"))
