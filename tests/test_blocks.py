"""Products block against block, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkring import queries
from sparkring.operators import blocks, linalg, prep
from sparkring.sources import graphs


@pytest.fixture(autouse=True)
def small(monkeypatch):
    """Several ranges for small graphs."""
    monkeypatch.setattr(blocks, "TARGET", 60)


def edges(n: int, m: int, seed: int) -> list[tuple[int, int]]:
    """With repeated edges, and a hub."""
    rng = random.Random(seed)
    some = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return some + some[: m // 5] + [(7, k) for k in range(n)]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def lower(pairs):
    return [(a, b) for a, b in pairs if b < a] + [(b, a) for a, b in pairs if a < b]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def made(df) -> int:
    """Joins that do not carry packed edges."""
    lines = plan(df).splitlines()
    return sum("Join" in x for x in lines) - sum("body" in x and "Relation" in x for x in lines)


@pytest.mark.parametrize("once", [False, True])
def test_masked(spark, once):
    a, b, mask = edges(60, 300, 1), edges(60, 300, 2), edges(60, 200, 3)
    want: Counter = Counter()
    x, y, m = (Counter(set(s)) if once else Counter(s) for s in (a, b, mask))
    for (i, k), n in m.items():
        val = sum(x[i, j] * y[j, k] for j in range(60)) * n
        if val:
            want[i, k] = val
    got = linalg.mxm_masked(*(frame(spark, s) for s in (a, b, mask)), once=once)
    assert rows(got) == sorted((i, k, n) for (i, k), n in want.items())
    assert made(got) <= 0


def test_pairs_of_groups(spark):
    held = [(g, m) for g in range(40) for m in random.Random(g).choices(range(30), k=g % 13)] + [(50, m) for m in range(300)] + [(None, 1), (1, None)]
    got = graphs.pairs(spark.createDataFrame(held, "g int, m int"), "g", "m")
    by = {}
    for g, m in held:
        if g is not None and m is not None:
            by.setdefault(g, []).append(m)
    want = [(max(p, q), min(p, q)) for ms in by.values() for k, p in enumerate(ms) for q in ms[:k] if p != q]
    assert rows(got) == sorted(want)


def test_bmm_masked_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TARGET", 20_000)
    assert made(queries.QUERIES["bmm_masked"](spark, "/root/testdata/sf0.001")) <= 0


def test_cuts_within_a_block(monkeypatch):
    """The same results when rows and walks are cut often."""
    monkeypatch.setattr(blocks, "CELLS", 64)
    monkeypatch.setattr(blocks, "WALKED", 50)
    rng = np.random.default_rng(4)
    a, b, m = (np.unique(rng.integers(0, 40, (300, 2)), axis=0) for _ in range(3))
    dense = [np.zeros((40, 40), np.int64) for _ in range(3)]
    for d, e in zip(dense, (a, b, m), strict=True):
        d[e[:, 0], e[:, 1]] = 1
    full = dense[0] @ dense[1]
    own = [blocks.dump(*blocks._sorted(e[:, i], e[:, 1 - i]), None) for e, i in ((a, 0), (b, 1), (m, 0))]
    for packed in (0, 4, 64):
        left, right, places = blocks._lines([own[0]], packed, False), blocks._lines([own[1]], packed, False), blocks._places([own[2]], False)
        assert int(next(blocks._totals(packed)(left, right, places))[0][0]) == (full * dense[2]).sum()
    left, right = blocks._lines([own[0]], 0, False), blocks._lines([own[1]], 0, False)
    for kind in ("count", "bool", "weighted"):
        got = np.zeros((40, 40))
        for i, k, *val in blocks._product(kind)(left, right, None):
            got[i, k] += val[0] if val else 1
        assert (got == ((full > 0) if kind == "bool" else full)).all()


def test_ids_far_apart(spark):
    a = [(i * 10**14, j * 10**13 + 5) for i, j in set(edges(40, 200, 5))]
    b = [(j, i) for i, j in a]
    want = Counter((i, k) for i, j in a for n, k in b if n == j)
    assert rows(linalg.mxm_masked(frame(spark, a), frame(spark, b), frame(spark, sorted(want)))) == sorted((*k, n) for k, n in want.items())


@pytest.mark.parametrize("once", [False, True])
def test_weighted(spark, once):
    a, b = edges(50, 250, 6), edges(50, 250, 7)
    left = frame(spark, a).withColumn("weight", (F.col("src") % 3).cast("double"))
    right = frame(spark, b).withColumn("weight", F.col("dst") * 0.5)
    want: Counter = Counter()
    for (i, j), n in (Counter(set(a)) if once else Counter(a)).items():
        for (x, k), m in (Counter(set(b)) if once else Counter(b)).items():
            if x == j:
                want[i, k] += n * m * (i % 3) * k * 0.5
    got = linalg.mxm_weighted(left, right, once)
    assert rows(got) == sorted((*k, v) for k, v in want.items()) and made(got) <= 0


@pytest.mark.parametrize("width", [4, 32])
def test_symbolic_in_words(spark, width):
    """Tiles that meet are ORed by words of 64, so no row is made for each tile of the product and what leads to it."""
    a, b = [(i, j) for i in range(0, 400, 3) for j in (i, i // 2)], [(j, k) for j in range(400) for k in (j, (j * 7) % 300)]
    tile = {(i // width, j // width) for i, j in a}, {(j // width, k // width) for j, k in b}
    want = Counter(i for i, _ in {(i, k) for i, j in tile[0] for x, k in tile[1] if x == j})
    got = linalg.mxm_symbolic(frame(spark, a), frame(spark, b), width)
    assert rows(got) == sorted(want.items()) and "bit_or" in plan(got)


#: Queries that make no row for each pair of edges.
WHOLE = [
    "bmm_weighted",
    "bmm_bool",
    "bmm_masked_packed_32",
    "bmm_masked_packed_64",
    "bmm_masked_sum",
    "bmm_masked_packed_16",
    "bmm_masked_packed_4",
    "bmm_masked_packed_8",
    "bmm_numeric",
    "reduce_masked",
    "triangles",
    "triangles_per_vertex",
    "triangles_packed",
]


@pytest.mark.parametrize("name", WHOLE)
def test_no_pairs_are_made(spark, monkeypatch, name):
    monkeypatch.setattr(blocks, "TARGET", 20_000)
    assert made(queries.QUERIES[name](spark, "/root/testdata/sf0.001")) <= 0


#: Queries whose product, on a graph without any order, is sent in waves.
WAVES = [
    "bmm_masked_packed_32",
    "bmm_masked_packed_64",
    "bmm_masked_sum",
    "bmm_masked_packed_16",
    "bmm_masked_packed_4",
    "bmm_masked_packed_8",
    "reduce_masked",
    "triangles",
]


@pytest.mark.parametrize("name", WAVES)
def test_little_is_sent_at_once(spark, monkeypatch, name):
    """At any time about as much as the packed edges themselves, though each range goes to half of the others."""
    query, at, held = queries.QUERIES[name], "/root/testdata/sf0.001", []
    monkeypatch.setattr(blocks, "TARGET", 10**6)
    want, meet = rows(query(spark, at)), blocks._meet

    def seen(sides, pairs, *rest):
        size = F.sum(F.octet_length("body"))
        held.append([sum(df.agg(size).first()[0] or 0 for df in dfs) for dfs in ([x for x, _ in sides], [x.join(pairs, on) for x, on in sides])])
        return meet(sides, pairs, *rest)

    monkeypatch.setattr(blocks, "TARGET", 1000)
    monkeypatch.setattr(blocks, "_meet", seen)
    got = query(spark, at)
    assert rows(got) == want and want
    own, sent = (np.array(x) for x in zip(*held, strict=True))
    assert sent.sum() > 3 * own[0] and sent.max() < 2 * own[0]


#: Queries whose packed edges lie there once, in blocks that are sent to few tasks though the graph has no order.
BLOCKS = [
    "bmm_masked_packed_64",
    "bmm_masked_sum",
    "bmm_masked_packed_4",
    "reduce_masked",
    "triangles",
    "bmm_masked_packed_16",
    "bmm_masked_packed_8",
]


@pytest.mark.parametrize("name", BLOCKS)
def test_blocks_are_sent_to_few_tasks(spark, monkeypatch, name):
    """As often as the root of the edges asks for; rows by columns, each range would go to half of the others."""
    query, at, held = queries.QUERIES[name], "/root/testdata/sf0.001", []
    monkeypatch.setattr(blocks, "TARGET", 10**6)
    want, meet = rows(query(spark, at)), blocks._meet

    def edges_of(dfs) -> int:
        return sum(len(blocks.parse(bytes(r["body"]))[0]) for df in dfs for r in df.select("body").collect())

    def seen(sides, pairs, *rest):
        held.append([edges_of(dfs) for dfs in ([x for x, _ in sides], [x.join(pairs, on) for x, on in sides])])
        return meet(sides, pairs, *rest)

    monkeypatch.setattr(blocks, "TARGET", 1000)
    monkeypatch.setattr(blocks, "_meet", seen)
    assert rows(query(spark, at)) == want and want
    n = graphs.copart_lower(spark, at).count()
    assert n > 10 * blocks.TARGET
    assert held[0][0] == n and sum(sent for _, sent in held) < 8 * n, (n, held)


def test_few_ranges_meet_in_vain(spark, monkeypatch):
    """Ranges of rows and columns that share no vertex are seldom sent to each other, though pieces of a graph do not end where ranges do."""
    meet, met = blocks._meet, []

    def seen(sides, pairs, *rest):
        shared = []
        for side, on in sides:
            by = {}
            for r in side.collect():
                by.setdefault(r[on[0]], set()).update(blocks.parse(bytes(r["body"]))[1].tolist())
            shared.append(by)
        met.append((pairs.count(), sum(bool(x & y) for x in shared[0].values() for y in shared[1].values())))
        return meet(sides, pairs, *rest)

    monkeypatch.setattr(blocks, "_meet", seen)
    some = [(10 * p + i, 10 * p + j) for p in range(40) for i in range(10) for j in range(i)]
    got = linalg.mxm(frame(spark, some), prep.transpose(frame(spark, some)))
    want = Counter((i, k) for i, j in some for k in range(j + 1, i - i % 10 + 10))
    assert rows(got) == sorted((*k, n) for k, n in want.items())
    assert met[0][1] <= met[0][0] <= 1.25 * met[0][1], met


#: Queries whose whole product, on a graph without any order, is not shuffled.
LYING = [
    "bmm_symbolic",
    "bmm_bool",
    "bmm_numeric",
    "bmm_weighted",
]


@pytest.mark.parametrize("name", LYING)
def test_ranges_are_read_where_they_lie(spark, monkeypatch, name):
    """Each range meets many others, but no task is sent one; before, each side was sent once for each range of the other."""
    query, at = queries.QUERIES[name], "/root/testdata/sf0.001"
    monkeypatch.setattr(blocks, "TARGET", 10**6)
    want = rows(query(spark, at))
    monkeypatch.setattr(blocks, "TARGET", 5 if name == "bmm_symbolic" else 5000)
    got = query(spark, at)
    ran = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in ran and "REPARTITION" not in ran and made(got) <= 0
    assert rows(got) == want and want


def test_borders_of_symbolic_ranges(spark):
    """Ranges begin within words of 64 columns; each column counts once."""
    rng = random.Random(8)
    a, b = ([(rng.randrange(300), rng.randrange(300)) for _ in range(500)] for _ in range(2))
    want = Counter(i for i, _ in {(i, k) for i, j in a for x, k in b if x == j})
    assert rows(blocks.product_sizes(frame(spark, a), frame(spark, b))) == sorted(want.items())
