"""Readers, writers, streams and the entry module."""

from __future__ import annotations

import datetime as dt
import importlib
import subprocess
import sys
from pathlib import Path

import pytest

from sparkring.operators import linalg
from sparkring.sources import dense, graphs, matrix_market
from sparkring.streaming import edges as stream

ROOT = Path(__file__).parents[1]


def put(path: Path, text: str) -> str:
    path.write_text(text)
    return str(path)


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*(names or df.columns)).collect())


@pytest.mark.parametrize(
    "line,code",
    [
        ("%%MatrixMarket matrix coordinate pattern general\n2 2 1", "MCPG"),
        ("%%MatrixMarket MATRIX Coordinate Real Symmetric\n% note\n\n3 3 0", "MCRS"),
        ("%%MatrixMarket matrix array integer general\n2 3", "MAIG"),
        ("%%MatrixMarket matrix coordinate complex hermitian\n1 1 1", "MCCH"),
        ("%%MatrixMarket matrix coordinate real skew-symmetric\n1 1 0", "MCRK"),
    ],
)
def test_headers(line, code):
    assert matrix_market.parse_header(line.split("\n")).code == code


@pytest.mark.parametrize(
    "line",
    ["", "MatrixMarket matrix coordinate real general\n1 1 1", "%%MatrixMarket tensor coordinate real general\n1 1 1", "%%MatrixMarket matrix coordinate odd general\n1 1 1",
     "%%MatrixMarket matrix array pattern general\n1 1", "%%MatrixMarket matrix coordinate real hermitian\n1 1 1", "%%MatrixMarket matrix coordinate pattern skew-symmetric\n1 1 1",
     "%%MatrixMarket matrix coordinate real general\n1 1", "%%MatrixMarket matrix coordinate real general\n% only notes"],
)
def test_bad_headers(line):
    with pytest.raises(ValueError):
        matrix_market.parse_header(line.split("\n"))


def test_coordinate_files(spark, tmp_path):
    pattern = put(tmp_path / "p.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n% a note\n4 4 4\n1 1\n2 1\n4 2\n4 2\n")
    assert rows(matrix_market.read_raw(spark, pattern), "src", "dst") == sorted([(0, 0), (1, 0), (3, 1), (3, 1), (0, 1), (1, 3), (1, 3)])
    assert rows(matrix_market.read_edges(spark, pattern)) == [(0, 1), (1, 0), (1, 3), (3, 1)]
    assert rows(matrix_market.read_edges(spark, pattern, directed=1)) == [(1, 0), (3, 1)]
    assert (0, 0) in rows(matrix_market.read_edges(spark, pattern, drop_self_loops=False))
    real = put(tmp_path / "r.mtx", "%%MatrixMarket matrix coordinate real general\n3 3 3\n1 2 0.5\n3 3 3\n2 1 -1e2\n")
    assert rows(matrix_market.read_raw(spark, real)) == [(0, 1, 0.5), (1, 0, -100.0), (2, 2, 3.0)]
    assert rows(matrix_market.read_edges(spark, real, directed=2)) == [(0, 1), (1, 0)]
    skew = put(tmp_path / "s.mtx", "%%MatrixMarket matrix coordinate integer skew-symmetric\n3 3 1\n3 1 4\n")
    assert rows(matrix_market.read_raw(spark, skew)) == [(0, 2, -4.0), (2, 0, 4.0)]
    array = put(tmp_path / "a.mtx", "%%MatrixMarket matrix array real general\n2 3\n1\n0\n0\n2\n3\n0\n")
    assert rows(matrix_market.read_raw(spark, array)) == [(0, 0, 1.0), (0, 2, 3.0), (1, 1, 2.0)]
    with pytest.raises(ValueError):
        matrix_market.read_raw(spark, put(tmp_path / "c.mtx", "%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1 0\n"))
    with pytest.raises(ValueError):
        matrix_market.read_edges(spark, pattern, directed=3)


def test_writer(spark, tmp_path):
    e = spark.createDataFrame([(2, 0, 1.5), (0, 1, 2.0)], "src long, dst long, weight double")
    for field in ("pattern", "real"):
        path = str(tmp_path / field)
        matrix_market.write(e, path, 3, 3, field=field, comment="made here")
        back = matrix_market.read_raw(spark, path)
        assert rows(back) == ([(0, 1, 2.0), (2, 0, 1.5)] if field == "real" else [(0, 1, 1.0), (2, 0, 1.0)])
    with pytest.raises(ValueError):
        matrix_market.write(e, str(tmp_path / "x"), 3, 3, field="complex")


def test_cache(spark, tmp_path):
    path = put(tmp_path / "g.mtx", "%%MatrixMarket matrix coordinate pattern general\n3 3 2\n1 2\n2 3\n")
    first = rows(matrix_market.cached(spark, path, str(tmp_path / "kept"), directed=2))
    Path(path).unlink()
    assert first == rows(matrix_market.cached(spark, path, str(tmp_path / "kept"), directed=2)) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_command_line(spark, tmp_path):
    from sparkring.__main__ import run

    # A triangle with a tail and a vertex alone, undirected.
    path = put(tmp_path / "g.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n5 5 5\n2 1\n3 1\n3 2\n4 3\n5 5\n")
    lines = lambda command, **k: "\n".join(run(spark, command, path, **k))
    assert "4 reached in 3 rounds" in lines("bfs", width=4) and "round 1: 2 new" in lines("bfs", cache=str(tmp_path / "kept"))
    assert "4 reached, farthest 2, 3 rounds" in lines("sssp")
    assert "2 components, 0 errors" in lines("cc") and "1 triangles" in lines("tc", width=8)
    assert "10 rounds" in lines("pr") and "0 entries differ" in lines("bmv", most=2)
    assert "sum 7, by pairs 7, at the triangle's places" in lines("bmm", width=64)
    with pytest.raises(ValueError):
        lines("other")


def test_dense_files(spark, tmp_path):
    m = dense.generate(spark, 32)
    dense.write(m, str(tmp_path / "m"))
    back = dense.read(spark, str(tmp_path / "m"), 32)
    assert rows(back) == rows(m.selectExpr("i", "j", "cast(value as double)"))
    product = linalg.dense_product(back, back)
    assert product.count() == 32 and {r["j"] for r in product.collect()} == {0}
    files = [put(tmp_path / f"{k}.csv", x) for k, x in (("rp", "3,0,1,2"), ("ci", "2\n1\n0"), ("block", "1,0\r\n0,1\r\n0,1,1,0"))]
    assert rows(dense.read_blocks(spark, *files, 2).where("value <> 0"), "i", "j") == [(0, 2), (1, 3), (2, 1), (3, 0)]


def test_stream(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    at = lambda minutes: day + dt.timedelta(minutes=minutes)
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    frame = lambda data: spark.createDataFrame(data, "src long, dst long, ts timestamp")
    frame([(1, 2, at(5)), (1, 3, at(50)), (2, 3, at(70))]).coalesce(1).write.parquet(source)
    degrees = stream.windowed_degrees(stream.read(spark, source))
    stream.start(degrees, sink, state).awaitTermination()
    frame([(9, 9, at(300))]).coalesce(1).write.mode("append").parquet(source)
    stream.start(degrees, sink, state).awaitTermination()
    got = {(r["window"]["start"].hour, r["v"], r["degree"]) for r in spark.read.parquet(sink).collect()}
    assert got == {(0, 1, 2), (1, 2, 1)}


TABLES = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_graphs(spark):
    d = str(TABLES)
    e = rows(graphs.copart(spark, d))
    assert all(a != b for a, b in e) and {(b, a) for a, b in e} == set(e)
    assert {(a, b) for a, b in rows(graphs.copart(spark, d, 49))} < set(e)
    assert graphs.nationtrade(spark, d).count() <= 625 and graphs.custsupp(spark, d).count() > graphs.nationtrade(spark, d).count()


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from sparkring.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in ("lineitem", "orders", "customer", "supplier", "part"):
        con.execute(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, str(TABLES))
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns), name
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key), name


def test_entry_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_library_does_not_import_llm():
    for path in (ROOT / "sparkring").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
    assert importlib.import_module("sparkring.queries").QUERIES


def test_products_of_the_whole_graph(spark, tmp_path):
    from collections import Counter

    from sparkring.queries import QUERIES

    lines = [(o, (o * 7 + k * k * 3) % 12, float(1 + (o + k) % 24)) for o in range(14) for k in range(3)]  # no quantity reaches 25
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    e = {(a, b) for o, a, _ in lines for o2, b, _ in lines if o == o2 and a != b}
    paths = [(i, j, k) for i, j in e for j2, k in e if j == j2]
    numeric = Counter((i, k) for i, j in e if j <= i for k, j2 in e if j2 <= k and j == j2)
    weighted = Counter()
    for i, _, k in paths:
        weighted[i, k] += (i % 7) * (k % 5)
    got = {x: QUERIES[f"bmm_{x}"](spark, str(tmp_path)) for x in ("numeric", "bool", "weighted")}
    assert rows(got["numeric"]) == sorted((*k, v) for k, v in numeric.items()) and numeric
    assert rows(got["bool"]) == sorted({(i, k) for i, _, k in paths})
    assert rows(got["weighted"]) == sorted((*k, float(v)) for k, v in weighted.items())


def test_boolean_product_of_the_whole_set(spark, tmp_path):
    from sparkring.queries import QUERIES

    lines = [(o, 30 + (o * 5 + k * k) % 20) for o in range(6) for k in range(2)]  # no id below 30
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(v,) for v in range(50)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    want = {b for o, a in lines for o2, b in lines if o == o2 and a != b and a % 3 == 0}
    assert rows(QUERIES["bmv_or"](spark, str(tmp_path))) == sorted((v,) for v in want) and want
    assert rows(QUERIES["bmv_or_masked"](spark, str(tmp_path))) == sorted((v,) for v in want if v % 2)
