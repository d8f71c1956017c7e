"""Sums of counter arrays over tasks, without gathering a key's arrays in memory."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tables

SCHEMA = "key string, counts binary"
CHUNK = 1 << 14


def dump(counts: np.ndarray) -> bytes:
    narrow = "<u4" if counts.min() >= 0 and counts.max() < 1 << 32 else "<i8"
    return narrow[1:].encode() + zlib.compress(np.ascontiguousarray(counts, dtype=narrow).tobytes(), 1)


def parse(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[2:]), dtype="<" + raw[:2].decode()).astype(np.int64)


def rows(name: str, counts: np.ndarray) -> pa.RecordBatch:
    """A task's counters, cut in chunks; chunks of zeros are left out."""
    cuts = [(f"{name}/{i // CHUNK:06d}", counts[i : i + CHUNK]) for i in range(0, len(counts), CHUNK)]
    cuts = [(k, dump(c)) for k, c in cuts if c.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in cuts], pa.string()), pa.array([c for _, c in cuts], pa.binary())], names=["key", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[key] = total[key] + parse(raw) if key in total else parse(raw)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(total), pa.array([dump(x) for x in total.values()], pa.binary())], names=["key", "counts"])


def collect(parts: DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """The summed arrays of the named keys at the driver; their sizes are fixed by the caller, not by the data.

    Every task adds up the chunks dealt to it one after another, so its memory is one array for each of its chunks.
    """
    out = {name: np.zeros(size, dtype=np.int64) for name, size in sizes.items()}
    for r in parts.repartition(tables.partitions(parts.sparkSession), "key").mapInArrow(_sum, SCHEMA).collect():
        name, _, i = r.key.rpartition("/")
        counts = parse(bytes(r.counts))
        out[name][int(i) * CHUNK : int(i) * CHUNK + len(counts)] = counts
    return out
