"""Removal of repeated windows against counting every window."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sparkring.llm import repeats, words


def covered(texts: list[str | None], window: int) -> list[bytes]:
    own = [(t or "").encode().split() for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in own for i in range(len(w) - window + 1))
    out = []
    for w in own:
        mark = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                mark[i : i + window] = b"\1" * window
        out.append(bytes(mark))
    return out


def test_levels_double_up_to_the_window():
    assert repeats.levels(35) == [9, 18, 35] and repeats.levels(5) == [5]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 27])
def test_slide(n):
    x = np.random.default_rng(n).integers(0, 100, 60)
    assert repeats.slide(x, n, np.minimum).tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]


@pytest.mark.parametrize("seed", range(60))
def test_every_level_keeps_all_repeated_windows(seed):
    rng = random.Random(seed)
    window, kinds = rng.choice([5, 9, 12]), rng.choice([2, 3, 30])
    texts = [" ".join(str(rng.randrange(kinds)) for _ in range(rng.choice([0, 3, 20, 60]))) for _ in range(6)]
    texts.append(" ".join(f"{texts[0]} {texts[1]}".split()[3:40]))
    want = covered(texts, window)
    w = next(words.split(pa.array(texts)))
    for length in repeats.levels(window, 3):
        found, _, _ = repeats.anchors(w.hash, w.first, length, window)
        value, count = np.unique(found, return_counts=True)
        alive = repeats.surviving(w.hash, w.first, [value[count > 1]] * len(texts), np.arange(len(texts)), length, window)
        mark = np.zeros(len(w.hash), np.uint8)
        for i in np.flatnonzero(alive):
            mark[i : i + window] = 1
        got = [mark[w.first[k] : w.first[k + 1]].tobytes() for k in range(len(texts))]
        if length == window:
            assert got == want
        assert all(a >= b for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def check(spark, rows: list[tuple], window: int) -> None:
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, hits string").repartition(3)
    marks = covered([t for _, t in rows], window)
    want = []
    for (key, text), mark in zip(rows, marks, strict=True):
        own = (text or "").encode().split()
        kept = [w for w, m in zip(own, mark, strict=True) if not m]
        want.append((repr(key), len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    got = [(repr(r[0]), *r[1:]) for r in repeats.remove(docs, window, digest=True).collect()]
    assert sorted(got) == sorted(want)


def test_removal(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(20)]
    rows: list[tuple] = [(None, " ".join(passage)), (1, None), (2, ""), (3, "too short"), (4, " ".join(passage[:11])), (4, " ".join(passage[:11]))]
    for k in range(5, 40):
        own = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(60))]
        if k % 3 == 0:
            own[3:3] = passage[: rng.randrange(8, 20)]
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(own)))
    rows += [(60, rows[20][1]), (61, rows[20][1]), (None, rows[21][1]), (62, " ".join(passage[2:])), (63, " ".join(passage[2:]))]
    rows += [(50, "same " * 300), (51, "a\x1cb " * 30), (52, "long " + " ".join(f"u{i}" for i in range(5000)))]
    check(spark, rows, 10)


def test_nothing_repeats(spark):
    check(spark, [(1, "one two three"), (2, "four five six"), (3, None)], 3)


def test_empty_table(spark):
    assert repeats.remove(spark.createDataFrame([], "doc_id long, text string"), 35, digest=True).collect() == []
    plain = repeats.remove(spark.createDataFrame([(1, "a b a b")], "doc_id long, text string"), 2)
    assert [tuple(r) for r in plain.collect()] == [(1, 4, 4, "")]


def test_slices_of_regions():
    lengths = [[3], [], [2, 4], [1]]
    hashed = np.arange(10, dtype=np.uint64)
    cuts, at = [], 0
    for own in lengths:
        cuts.append(hashed[at : at + sum(own)].tobytes())
        at += sum(own)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([b"a", b"b", b"c", b"d"]), pa.array([[5] * len(x) for x in lengths], pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32())), pa.array(cuts, pa.binary())],
        names=["key", "starts", "lengths", "words"],
    )
    for most in (1, 30, 1000):
        parts = list(repeats._slices(iter([batch, batch.slice(0, 0)]), most))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
        units = [repeats._units(x) for x in parts]
        assert np.concatenate([u[0] for u in units]).tolist() == hashed.tolist()
        assert [int(n) for u in units for n in np.diff(u[1])] == [3, 2, 4, 1]
