"""Packed products and searches, edges in buckets, and file checks, against plain Python."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkring.functions import semiring
from sparkring.operators import linalg, prep, tiles
from sparkring.plans import pagerank, search
from sparkring.sources import dense, matrix_market
from sparkring.workspace import Workspace, shared_folder


def random_edges(n: int, m: int, seed: int) -> set[tuple[int, int]]:
    rng = random.Random(seed)
    return {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


def frame(spark, pairs, extra: str = ""):
    return spark.createDataFrame(sorted(pairs), "src long, dst long" + extra)


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("width", [4, 8, 16, 32, 64])
def test_products(spark, width):
    pairs = random_edges(150, 900, width)
    e, rng = frame(spark, pairs), random.Random(1)
    x = {v: rng.randrange(1, 40) for v in rng.sample(range(150), 60)}
    known = set(rng.sample(range(150), 50))
    values = spark.createDataFrame(list(x.items()), "v long, val long")
    members, mask = values.select("v"), spark.createDataFrame([(v,) for v in known], "v long")
    matrix = tiles.pack(e, width)
    met = {a for a, b in pairs if b in x}
    assert {r[0] for r in rows(tiles.unpack_set(linalg.mxv_bool_packed(matrix, tiles.pack_set(members, width), None, width), width))} == met
    left = linalg.mxv_bool_packed(matrix, tiles.pack_set(members, width), tiles.pack_set(mask, width), width)
    assert {r[0] for r in rows(tiles.unpack_set(left, width))} == met - known and left.where("word = 0").count() == 0
    blocks = tiles.pack_values(values, width)
    for kind, product in (("min_plus", lambda a, b: x[b] + 3), ("min_second", lambda a, b: x[b]), ("counting", lambda a, b: 1), ("plus_times", lambda a, b: 3.0 * x[b])):
        want: dict = {}
        for a, b in pairs:
            if b in x:
                want.setdefault(a, []).append(product(a, b))
        add = min if kind.startswith("min") else sum
        got = linalg.mxv_values_packed(matrix, blocks, semiring.ALL[kind], width, F.lit(3))
        assert rows(got) == {(a, add(p)) for a, p in want.items()}
    total = sum(Counter(b for _, b in pairs)[j] * n for j, n in Counter(a for a, _ in pairs).items())
    assert linalg.mxm_sum_packed(e, e, width).first()[0] == total == linalg.mxm_sum(e, e).first()[0]
    assert linalg.mxm_sum_packed(e.limit(0), e, width).first()[0] == 0


def test_masked_product_with_hubs(spark):
    """Places walk along the shorter side: rows of A that are long, and columns of B that are."""
    a = random_edges(40, 150, 2) | {(0, j) for j in range(40)}
    b = random_edges(40, 150, 3) | {(j, 1) for j in range(40)}
    mask = random_edges(40, 300, 4) | {(0, 1), (0, 2), (3, 1)}
    want = Counter((i, k) for i, k in mask for j in range(40) if (i, j) in a and (j, k) in b)
    got = linalg.mxm_masked(*(frame(spark, x) for x in (a, b, mask)))
    assert rows(got) == {(i, k, n) for (i, k), n in want.items()}
    assert linalg.mxm_masked_sum(*(frame(spark, x) for x in (a, b, mask))).first()[0] == sum(want.values())


@pytest.mark.parametrize("width", [4, 64])
def test_search_on_tiles(spark, width):
    e = frame(spark, random_edges(200, 350, 5) | {(300, 301)})
    found, counts = search.bfs(e, 0)
    packed, more = search.bfs_packed(e, 0, width)
    assert rows(packed.select("v", "level")) == rows(found.select("v", "level")) and counts == more
    some, counts = search.bfs_packed(e, 0, width, max_rounds=1)
    assert len(counts) == 1 and {r["level"] for r in some.collect()} <= {0, 1}


def test_edges_in_buckets(spark):
    """A hub's edges are dealt over parts; every edge meets its vertex's value once."""
    pairs = random_edges(60, 200, 6) | {(7, k) for k in range(500)} | {(k, 7) for k in range(100)}
    own = Workspace(spark, "test").clustered(frame(spark, pairs), "edges", least=20)
    hubs = dict(rows(own.hubs))
    assert hubs and 7 in hubs and len(hubs) < 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = spark.createDataFrame([(v, v * v) for v in range(0, 60, 2)], "v long, val long")
    joined = own.joined(x)
    assert sorted(tuple(r) for r in joined.select("src", "dst", "val").collect()) == sorted((a, b, a * a) for a, b in pairs if a % 2 == 0 and a < 60)
    x7 = spark.createDataFrame([(7, 1)], "v long, val long")
    assert own.joined(x7).count() == len([1 for a, _ in pairs if a == 7])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = own.joined(x)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # the edges stay where they are
    own.forget()


def test_pagerank_with_a_hub(spark, monkeypatch):
    whole = Workspace.clustered
    monkeypatch.setattr(Workspace, "clustered", lambda self, edges, name: whole(self, edges, name, least=5))
    pairs = random_edges(30, 60, 7) | {(0, k) for k in range(30)}
    ranks = {r["v"]: r["rank"] for r in pagerank.pagerank(frame(spark, pairs), spark.range(30).withColumnRenamed("id", "v"), epsilon=0.0).ranks.collect()}
    degree, p = Counter(a for a, _ in pairs), dict.fromkeys(range(30), 1 / 30)
    for _ in range(10):
        p = {v: 0.15 / 30 + sum(0.85 * p[a] / degree[a] for a, b in pairs if b == v) for v in range(30)}
    assert all(abs(ranks[v] - p[v]) < 1e-12 for v in range(30))


def test_running_sums(spark):
    values = {k * k: k % 5 for k in range(40)}
    for buckets in (1, 7, 4096):
        got = prep.running(spark.createDataFrame(list(values.items()), "k long, x long"), "k", "x", "before", buckets)
        assert rows(got.select("k", "before")) == {(k, sum(x for j, x in values.items() if j < k)) for k in values}


def test_folder_of_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://there:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared_folder(Session())


# Files


def put(path: Path, text: str) -> str:
    path.write_text(text)
    return str(path)


def test_a_header_after_many_comments(spark, tmp_path):
    notes = "".join(f"% note {i}\n" for i in range(5000))
    path = put(tmp_path / "a.mtx", f"%%MatrixMarket matrix coordinate real general\n{notes}\n3 3 2\n1 2 0.5\n\n3 3 -2\n")
    assert matrix_market.read_header(spark, path).entries == 2
    assert rows(matrix_market.read_raw(spark, path)) == {(0, 1, 0.5), (2, 2, -2.0)}


@pytest.mark.parametrize("body", ["3 3 2\n1 2 0.5\n", "3 3 2\n1 2 0.5\n2 2\n", "3 3 2\n1 2 0.5\n4 1 1\n", "3 3 2\n1 2 0.5\n0 1 1\n", "3 3 2\n1 2 x\n1 1 1\n", "3 3 1\n1 2 0.5\n1 1 1\n", "3 3 2\n1 2 0.5\n1 1 1 1\n"])
def test_files_that_are_not_as_declared(spark, tmp_path, body):
    with pytest.raises(ValueError):
        matrix_market.read_raw(spark, put(tmp_path / "a.mtx", f"%%MatrixMarket matrix coordinate real general\n{body}"))


def test_an_entry_like_the_size_line(spark, tmp_path):
    path = put(tmp_path / "a.mtx", "%%MatrixMarket matrix coordinate integer general\n3 3 3\n3 3 3\n1 1 2\n3 3 3\n")
    assert sorted(tuple(r) for r in matrix_market.read_raw(spark, path).collect()) == [(0, 0, 2.0), (2, 2, 3.0), (2, 2, 3.0)]


@pytest.mark.parametrize("kind", ["general", "symmetric", "skew-symmetric"])
def test_arrays(spark, tmp_path, kind):
    n = 37
    value = {(i, j): (i * 5 + j * 11) % 7 for i in range(n) for j in range(n)}
    cells = spark.createDataFrame([(i, j, float(x)) for (i, j), x in value.items()], "i long, j long, value double")
    matrix_market.write_array(cells, str(tmp_path / "a"), n, n, kind)
    want = {(i, j, float(x)) for (i, j), x in value.items() if x and (kind == "general" or i > j or i == j and kind == "symmetric")}
    sign = -1 if kind.startswith("skew") else 1
    if kind != "general":
        want |= {(j, i, sign * x) for i, j, x in want if i != j}
    assert rows(matrix_market.read_raw(spark, str(tmp_path / "a"))) == want
    with pytest.raises(ValueError):
        matrix_market.read_raw(spark, put(tmp_path / "b.mtx", f"%%MatrixMarket matrix array real {kind}\n3 3\n1\n2\n"))


def test_a_file_in_many_splits(spark, tmp_path):
    path = put(tmp_path / "m.csv", "\n".join(f"{i},{i + 1}" for i in range(0, 20_000, 2)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        assert dense.read(spark, path, 100).where("value <> i * 100 + j").count() == 0
        assert dense.read(spark, path, 100).count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
