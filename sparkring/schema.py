"""Column names and schemas of edges, tiles and vectors.

edges   (src, dst[, weight])      0-based ids; an edge is a non-zero of the adjacency matrix
tiles   (brow, bcol, r, word)     one packed row of a non-empty square tile, most significant bit first
vectors (v, val), or (v) for sets an absent row is the semiring's identity
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

WIDTHS = (4, 8, 16, 32, 64)

EDGES = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False)])
TILES = T.StructType(
    [T.StructField("brow", T.LongType()), T.StructField("bcol", T.LongType()), T.StructField("r", T.IntegerType()), T.StructField("word", T.LongType())]
)
SET = T.StructType([T.StructField("v", T.LongType())])


def check_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing from {df.columns}")
    return df


def check_width(width: int) -> int:
    if width not in WIDTHS:
        raise ValueError(f"tile width must be one of {WIDTHS}, not {width}")
    return width
