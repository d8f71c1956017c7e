"""Operators on small and random graphs, against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from sparkring.functions import bits, semiring
from sparkring.operators import balance, linalg, prep, tiles, vector, verify
from sparkring.plans import components, pagerank, search, triangles
from sparkring.schema import check_columns, check_width


def edges_of(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src long, dst long")


def random_pairs(n: int, m: int, seed: int, loops: bool = True) -> set[tuple[int, int]]:
    rng = random.Random(seed)
    out = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return out if loops else {(a, b) for a, b in out if a != b}


def pairs_of(df, *names):
    return {tuple(r) for r in df.select(*(names or df.columns)).collect()}


def undirected(pairs):
    return {(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b}


# Preparation


def test_preparation(spark):
    raw = [(1, 2), (2, 1), (3, 3), (1, 2), (4, 1)]
    e = spark.createDataFrame(raw, "src long, dst long")
    assert pairs_of(prep.clean(e)) == {(1, 2), (2, 1), (4, 1)}
    assert pairs_of(prep.clean(e, directed=False)) == undirected(raw)
    assert (3, 3) in pairs_of(prep.clean(e, drop_self_loops=False))
    assert pairs_of(prep.rebase(e)) == {(a - 1, b - 1) for a, b in raw}
    assert pairs_of(prep.transpose(e)) == {(b, a) for a, b in raw}
    assert pairs_of(prep.tril(e)) == {(2, 1), (3, 3), (4, 1)}
    assert prep.dedupe(e).count() == 4 and [tuple(r) for r in prep.ordered(e).collect()] == sorted(raw)
    assert pairs_of(prep.vertices(e)) == {(1,), (2,), (3,), (4,)}
    weighted = e.withColumn("weight", F.lit(2.0))
    assert prep.transpose(weighted).columns == ["src", "dst", "weight"] and prep.pattern(weighted).columns == ["src", "dst"]


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_row_pointers(spark, buckets):
    pairs = random_pairs(50, 200, 1)
    degree, start, want = Counter(a for a, _ in pairs), 0, set()
    for v in sorted(degree):
        want.add((v, start, degree[v]))
        start += degree[v]
    assert pairs_of(prep.row_pointers(edges_of(spark, pairs), buckets)) == want


# Packing


@pytest.mark.parametrize("width", [4, 8, 16, 32, 64])
def test_pack_and_unpack(spark, width):
    pairs = random_pairs(150, 600, width)
    e = edges_of(spark, pairs)
    for by in ("row", "col"):
        packed = tiles.pack(e, width, by)
        assert pairs_of(tiles.unpack(packed, width, by), "src", "dst") == pairs
        assert packed.agg(F.sum(bits.popcount("word"))).first()[0] == len(pairs)
    members = {a for a, _ in pairs}
    words = tiles.pack_set(prep.every(prep.vertices(e), F.col("v").isin(sorted(members))), width)
    assert {v for (v,) in pairs_of(tiles.unpack_set(words, width))} == members
    assert tiles.tile_count(e, width).first()[0] == len({(a // width, b // width) for a, b in pairs})


def test_bit_order_is_most_significant_first(spark):
    row = tiles.pack(edges_of(spark, {(5, 9)}), 8).first()
    assert tuple(row) == (0, 1, 5, 1 << (7 - 1))
    assert tiles.pack(edges_of(spark, {(0, 0)}), 64).first()["word"] == -(1 << 63)
    assert tiles.pack(edges_of(spark, {(0, 3)}), 4).select(bits.show_bits("word", 4)).first()[0] == "0001"
    with pytest.raises(ValueError):
        check_width(7)
    with pytest.raises(ValueError):
        check_columns(edges_of(spark, {(0, 0)}), "src", "weight")


def test_align_and_repack(spark):
    pairs = random_pairs(100, 300, 3)
    packed = tiles.pack(edges_of(spark, pairs), 8)
    rows = defaultdict(dict)
    for brow, bcol, r, word in pairs_of(packed):
        rows[brow].setdefault(bcol, {})[r] = word
    want = defaultdict(int)
    for brow, cols in rows.items():
        for k, bcol in enumerate(sorted(cols)):
            for r, word in cols[bcol].items():
                want[brow, k // 4, r] |= word << (24 - k % 4 * 8)
    assert pairs_of(tiles.align(packed, 8, 32)) == {(*k, v) for k, v in want.items()}
    assert pairs_of(tiles.repack(packed, 8, 32)) == pairs_of(tiles.pack(edges_of(spark, pairs), 32))


def test_sizes(spark):
    # A symmetric 64 x 64 matrix with seven stored entries: eight after mirroring.
    pairs = {(0, 0), (1, 1), (2, 2), (32, 32), (33, 33), (34, 34), (0, 44), (44, 0)}
    e = edges_of(spark, pairs)
    assert {r["width"]: r["tiles"] for r in tiles.occupancy(e, 64).collect()} == {4: 4, 8: 4, 16: 4, 32: 4, 64: 1}
    got = {r["width"]: (r["csr_bytes"], r["bsr_bytes"]) for r in tiles.footprint(e, 64).collect()}
    assert got == {4: (324, 100), 8: (324, 84), 16: (324, 164), 32: (324, 540), 64: (324, 524)}
    assert tiles.readable(1536) == "1.50 KB" and tiles.readable(10) == "10.00 B"
    pointers = spark.createDataFrame([(0, 0, 2), (1, 2, 2), (2, 2, 3)], "brow int, start int, end int")
    assert pairs_of(tiles.expand_pointers(pointers)) == {(0, 0), (0, 1), (2, 2)}


# Products


@pytest.mark.parametrize("seed", [1, 2])
def test_matrix_by_vector(spark, seed):
    pairs = random_pairs(120, 500, seed)
    e = edges_of(spark, pairs)
    x = {v: v * 7 % 13 for v in range(0, 120, 3)}
    vec = spark.createDataFrame(list(x.items()), "v long, val long")
    want = Counter(a for a, b in pairs if b in x)
    assert pairs_of(linalg.mxv(e, vec.select("v"))) == set(want.items())
    assert pairs_of(balance.salted_count(e, vec)) == set(want.items())
    assert pairs_of(linalg.mxv(e, linalg.staged(vec.select("v"), 1000))) == pairs_of(linalg.mxv(e, linalg.staged(vec.select("v"), 1)))
    for width in (4, 8, 16, 32, 64):
        assert pairs_of(linalg.mxv_packed(tiles.pack(e, width), tiles.pack_set(vec, width), width)) == set(want.items())
    low, second, boolean = {}, {}, set()
    for a, b in pairs:
        if b in x:
            low[a], second[a] = min(low.get(a, 99), x[b] + 1), min(second.get(a, 99), x[b])
            boolean.add(a)
    assert pairs_of(linalg.mxv(e, vec, semiring.MIN_PLUS)) == set(low.items())
    assert pairs_of(linalg.mxv(e, vec, semiring.MIN_SECOND)) == set(second.items())
    assert {v for v, _ in pairs_of(linalg.mxv(e, vec, semiring.BOOLEAN))} == boolean
    times = linalg.mxv(e.withColumn("weight", F.lit(2.0)), vec, semiring.PLUS_TIMES)
    total = defaultdict(float)
    for a, b in pairs:
        if b in x:
            total[a] += 2.0 * x[b]
    assert pairs_of(times) == set(total.items())
    assert pairs_of(linalg.vxm(vec.select("v"), e)) == set(Counter(b for a, b in pairs if a in x).items())
    reach = {b for a, b in pairs if a in x}
    assert {v for (v,) in pairs_of(linalg.mxv_bool(e, vec))} == reach
    assert {v for (v,) in pairs_of(linalg.mxv_bool(e, vec, mask=vec))} == reach - set(x)
    assert set(semiring.ALL) == {"counting", "boolean", "min_plus", "plus_times", "min_second"}


def test_matrix_by_matrix(spark):
    pa, pb, pm = (random_pairs(60, 220, s) for s in (4, 5, 6))
    a, b, m = (edges_of(spark, p) for p in (pa, pb, pm))
    product = Counter((i, k) for i, j in pa for j2, k in pb if j == j2)
    assert {(i, k, v) for (i, k), v in product.items()} == pairs_of(linalg.mxm(a, b))
    assert pairs_of(linalg.mxm_bool(a, b)) == set(product)
    assert linalg.mxm_sum(a, b).first()[0] == linalg.mxm_sum_pairs(a, b).first()[0] == sum(product.values())
    masked = {k: v for k, v in product.items() if k in pm}
    assert pairs_of(linalg.mxm_masked(a, b, m)) == {(*k, v) for k, v in masked.items()}
    assert linalg.mxm_masked_sum(a, b, m).first()[0] == sum(masked.values())
    assert vector.masked_total(linalg.mxm(a, b), m).first()[0] == sum(masked.values())
    for width in (4, 8, 16, 32, 64):
        assert linalg.mxm_masked_sum_packed(a, b, m, width).first()[0] == sum(masked.values())
        ta, tb = ({(x // width, y // width) for x, y in p} for p in (pa, pb))
        symbolic = Counter(i for i, _ in {(i, k) for i, j in ta for j2, k in tb if j == j2})
        assert pairs_of(linalg.mxm_symbolic(a, b, width)) == set(symbolic.items())
    weighted = linalg.mxm_weighted(a.withColumn("weight", F.lit(0.5)), b)
    assert pairs_of(weighted) == {(*k, v * 0.5) for k, v in product.items()}
    empty = a.limit(0)
    assert linalg.mxm_sum(empty, b).first()[0] == linalg.mxm_masked_sum_packed(empty, b, m).first()[0] == 0


# Vectors


def test_element_wise(spark):
    a, b = {1: 5, 2: 7, 3: 1}, {2: 7, 3: 4, 9: 0}
    va, vb = (spark.createDataFrame(list(x.items()), "v long, val long") for x in (a, b))
    assert pairs_of(vector.minimum(va, vb)) == {(1, 5), (2, 7), (3, 1), (9, 0)}
    assert pairs_of(vector.less(va, vb)) == {(1, 1), (2, 0), (3, 1), (9, 0)}
    assert pairs_of(vector.differs(va, vb)) == {(1, 1), (2, 0), (3, 1), (9, 1)}
    assert pairs_of(vector.subtract(va, vb)) == {(2, 0), (3, -3)} and pairs_of(vector.multiply(va, vb)) == {(2, 49), (3, 4)}
    assert pairs_of(vector.add_value(va, 2)) == {(1, 7), (2, 9), (3, 3)} and pairs_of(vector.keep_where(va, vb)) == {(2, 7), (3, 1)}
    assert pairs_of(vector.set_element(va, 2, 0)) == {(1, 5), (2, 0), (3, 1)} and pairs_of(vector.fill(va, 3)) == {(1, 3), (2, 3), (3, 3)}
    assert pairs_of(vector.iota(spark, 3)) == {(0, 0), (1, 1), (2, 2)}
    assert pairs_of(vector.gather(va, spark.createDataFrame([(0, 3), (1, 3), (2, 8)], "v long, val long"))) == {(0, 1), (1, 1)}
    assert pairs_of(vector.scatter_min(va, spark.createDataFrame([(1, 4), (2, 4), (3, 6)], "v long, val long"))) == {(4, 5), (6, 1)}
    assert pairs_of(vector.union(va, vb)) == {(1,), (2,), (3,), (9,)} and pairs_of(vector.minus(va, vb)) == {(1,)} and pairs_of(vector.common(va, vb)) == {(2,), (3,)}
    wa, wb = tiles.pack_set(va, 8), tiles.pack_set(vb, 8)
    assert pairs_of(tiles.unpack_set(vector.union_words(wa, wb), 8)) == {(1,), (2,), (3,), (9,)}
    assert pairs_of(tiles.unpack_set(vector.minus_words(wa, wb), 8)) == {(1,)}
    assert vector.popcount_words(wa).first()[0] == 3 and vector.popcount_words(wa.limit(0)).first()[0] == 0
    assert vector.total(va).first()[0] == 13 and vector.total_finite(va, 6).first()[0] == 6
    assert vector.l2_difference(va, vb).first()[0] == pytest.approx((25 + 9) ** 0.5)
    assert vector.nonzeros(vb).first()[0] == 2 and vector.distinct_labels(vb).first()[0] == 3
    assert [tuple(r) for r in vector.top(va, 2).collect()] == [(2, 7), (1, 5)]
    report = vector.load_report(spark.createDataFrame([(0, 2), (1, 4), (2, 4)], "unit long, load long")).first()
    assert (report["least"], report["most"], report["busiest"]) == (2, 4, 2) and report["deviation"] == pytest.approx((8 / 9) ** 0.5)


# Workloads


def test_workloads(spark):
    loads = {0: 3, 1: 0, 2: 25, 3: 4, 4: 4, 5: 10, 6: 1}
    frame = spark.createDataFrame(list(loads.items()), "brow long, load long").repartition(3)
    pieces = pairs_of(balance.split(frame, 10))
    assert {(2, 0, 10), (2, 10, 10), (2, 20, 5), (0, 0, 3)} <= pieces and all(0 < n <= 10 for _, _, n in pieces)
    for units in (balance.merge(frame, 10), balance.merge_split(frame, 10)):
        total, seen = Counter(), defaultdict(int)
        for unit, brow, start, load in sorted(pairs_of(units)):
            total[brow] += load
            seen[unit] += load
            assert load > 0 and start + load <= loads[brow]
        assert total == {k: v for k, v in loads.items() if v}
    assert sorted(seen.values(), reverse=True) == [10, 10, 10, 10, 7]
    merged = defaultdict(set)
    for unit, brow, _, _ in pairs_of(balance.merge(frame, 10)):
        merged[unit].add(brow)
    assert list(merged[k] for k in sorted(merged)) == [{0}, {2}, {3, 4}, {5}, {6}]
    units = balance.merge_split(frame, 10)
    sizes, at = Counter(u for u, *_ in pairs_of(units)), 0
    for unit, start, end in sorted(pairs_of(balance.unit_offsets(units))):
        assert (start, end) == (at, at + sizes[unit] + 2)
        at = end


# Algorithms


def levels(pairs, source):
    near, out, todo = defaultdict(set), {source: 0}, deque([source])
    for a, b in pairs:
        near[a].add(b)
    while todo:
        a = todo.popleft()
        for b in near[a]:
            if b not in out:
                out[b] = out[a] + 1
                todo.append(b)
    return out


@pytest.mark.parametrize("seed,n,m", [(1, 60, 90), (2, 40, 300)])
def test_search(spark, seed, n, m):
    pairs = random_pairs(n, m, seed, loops=False)
    e = edges_of(spark, pairs)
    want = levels(pairs, 0)
    found, counts = search.bfs(e, 0)
    assert pairs_of(found) == set(want.items())
    assert counts == [Counter(want.values())[d] for d in range(1, max(want.values()) + 2)]
    dist, rounds = search.sssp(e, 0)
    assert pairs_of(dist) == set(want.items()) and rounds == max(want.values()) + 1
    some, counts = search.bfs(e, 0, max_rounds=1)
    assert len(counts) == 1 and set(r["level"] for r in some.collect()) <= {0, 1}


def test_long_search(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_PARTS", 4)
    found, counts = search.bfs(edges_of(spark, {(i, i + 1) for i in range(11)}), 0)
    assert pairs_of(found) == {(i, i) for i in range(12)} and counts == [1] * 11 + [0]


def test_weighted_paths(spark):
    e = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.5), (1, 3, 1.0), (5, 0, 1.0)], "src long, dst long, weight double")
    assert pairs_of(search.sssp(e, 0)[0]) == {(0, 0.0), (1, 2.5), (2, 1.0), (3, 3.5)}


def test_pagerank(spark):
    pairs = random_pairs(30, 80, 7)
    raw = [*pairs, *list(pairs)[:5]]  # repeated edges count
    n, degree = 30, Counter(a for a, _ in raw)
    p = {v: 1 / n for v in range(n)}
    for _ in range(10):
        got = defaultdict(float)
        for a, b in raw:
            got[b] += 0.85 * p[a] / degree[a]
        p = {v: got[v] + 0.15 / n for v in range(n)}
    vertices = spark.range(n).withColumnRenamed("id", "v")
    out = pagerank.pagerank(spark.createDataFrame(raw, "src long, dst long"), vertices, epsilon=0.0)
    assert out.rounds == 10 and out.error > 0
    assert all(abs(r["rank"] - p[r["v"]]) < 1e-12 for r in out.ranks.collect())
    ring = edges_of(spark, {(i, (i + 1) % 4) for i in range(4)})
    out = pagerank.pagerank(ring, prep.vertices(ring))
    assert out.rounds == 1 and out.ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1)
    assert pagerank.pagerank(ring, vertices.limit(0)).rounds == 0


def test_components(spark):
    pairs = random_pairs(120, 90, 8) | {(200, k) for k in range(201, 240)} | {(k, k + 1) for k in range(300, 340)}
    e = edges_of(spark, pairs)
    domain = spark.range(360).withColumnRenamed("id", "v")
    labels = components.connected_components(e, domain)
    want = {}
    for v in range(360):
        if v not in want:
            want.update({u: v for u in levels(undirected(pairs), v)})
    assert pairs_of(labels) == set(want.items())
    checked = verify.check_components(e, labels).first()
    assert checked["errors"] == 0 and checked["components"] == len(set(want.values()))
    wrong = labels.select("v", F.when(F.col("v") == 201, 5).otherwise(F.col("val")).alias("val"))
    assert verify.check_components(e, wrong).first()["errors"] == 1


@pytest.mark.parametrize("seed", [9, 10])
def test_triangles(spark, seed):
    pairs = undirected(random_pairs(50, 400, seed))
    found = {frozenset((a, b, c)) for a, b in pairs for c in range(50) if (b, c) in pairs and (a, c) in pairs and len({a, b, c}) == 3}
    e = edges_of(spark, pairs)
    assert triangles.count(e).first()[0] == len(found)
    for width in (8, 64):
        assert triangles.count_packed(e, width).first()[0] == len(found)
    assert pairs_of(triangles.per_vertex(e)) == set(Counter(v for t in found for v in t).items())
    assert pairs_of(triangles.oriented(e)) <= pairs and triangles.oriented(e).count() == len(pairs) // 2


# Verification


def test_verification(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "v long, val double")
    b = spark.createDataFrame([(1, 1.0 + 1e-9), (3, 1.0)], "v long, val double")
    assert verify.mismatches(a, b).first()[0] == 2
    assert verify.packed_mismatches(tiles.pack_set(a, 32), b).first()[0] == 2
    timer = verify.Timer()
    assert timer.run(lambda: 5, times=3) == 5 and timer.report()["least"] >= 0 and len(timer.seconds) == 3
