"""One query for each operator over the star schema's graphs, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, semiring
from .operators import balance, linalg, prep, tiles, vector, verify
from .plans import components, pagerank, search, triangles
from .sources import dense, graphs, matrix_market
from .workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Graphs in SQL.
_COPART = "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey"
_COPART49 = f"{_COPART} AND a.l_quantity >= 49 AND b.l_quantity >= 49"
_CUSTSUPP = "SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
_SUPPPART = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem"
_TRADE = f"""SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst
    FROM ({_CUSTSUPP}) JOIN customer ON c_custkey = src JOIN supplier ON s_suppkey = dst"""
_E = f"WITH e AS ({_COPART}) "
_L = f"WITH e AS ({_COPART}), l AS (SELECT * FROM e WHERE dst <= src) "
_T = f"WITH e AS ({_TRADE}) "
# Vectors: a third of the parts as a set, and values by rule.
_X = "(SELECT p_partkey AS v FROM part WHERE p_partkey % 3 = 0)"
_A = "(SELECT p_partkey AS v, p_partkey * 7 % 101 AS val FROM part WHERE p_partkey % 2 = 0)"
_B = "(SELECT p_partkey AS v, p_partkey * 5 % 97 AS val FROM part WHERE p_partkey % 3 = 0)"


def _set(spark: SparkSession, d: str) -> DataFrame:
    return prep.every(graphs.parts(spark, d), F.col("v") % 3 == 0)


def _a(spark: SparkSession, d: str) -> DataFrame:
    return graphs.parts(spark, d).where("v % 2 = 0").select("v", (F.col("v") * 7 % 101).alias("val"))


def _b(spark: SparkSession, d: str) -> DataFrame:
    return graphs.parts(spark, d).where("v % 3 = 0").select("v", (F.col("v") * 5 % 97).alias("val"))


def _lower(spark: SparkSession, d: str) -> DataFrame:
    return prep.tril(graphs.copart(spark, d))


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL."""

    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return keep


def _register(name: str, f: Query, sql: str | None) -> None:
    query(sql, name)(f)


# Sources and preparation.
_register("edges_copart", graphs.copart, _COPART)
_register("edges_custsupp", graphs.custsupp, _CUSTSUPP)
_register("edges_supppart", graphs.supppart, _SUPPPART)
_register("edges_nationtrade", graphs.nationtrade, _TRADE)
_register("generate_matrix", lambda s, d: dense.generate(s, 32), "SELECT i // 32 AS i, i % 32 AS j, CAST(i % 32 = 0 AS INTEGER) AS value FROM range(1024) t(i)")
_register("rebase", lambda s, d: prep.rebase(graphs.nationtrade(s, d), 1), _T + "SELECT src - 1 AS src, dst - 1 AS dst FROM e")
_register("symmetrize", lambda s, d: prep.symmetrize(graphs.nationtrade(s, d)), _T + "SELECT src, dst FROM e UNION SELECT dst, src FROM e")
_register("drop_loops", lambda s, d: prep.drop_loops(graphs.nationtrade(s, d)), _T + "SELECT * FROM e WHERE src <> dst")
_register("zero_diagonal", lambda s, d: prep.zero_diagonal(graphs.nationtrade(s, d)), _T + "SELECT * FROM e WHERE src <> dst")
_register(
    "dedupe",
    lambda s, d: prep.dedupe(graphs.table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))),
    _SUPPPART,
)
_register("transpose", lambda s, d: prep.transpose(graphs.supppart(s, d)), f"SELECT dst AS src, src AS dst FROM ({_SUPPPART})")
_register("tril", _lower, _L + "SELECT * FROM l")
_register("clean_edges", lambda s, d: prep.clean(graphs.nationtrade(s, d), directed=False), _T + "SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst")
_register("sorted_edges", lambda s, d: prep.ordered(graphs.nationtrade(s, d)), _T + "SELECT * FROM e ORDER BY src, dst")
_register(
    "force_pattern",
    lambda s, d: prep.pattern(graphs.table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_quantity")),
    "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem",
)
_register("out_degree", lambda s, d: prep.out_degree(graphs.custsupp(s, d)), f"SELECT src AS v, count(*) AS degree FROM ({_CUSTSUPP}) GROUP BY src")
_register("in_degree", lambda s, d: prep.in_degree(graphs.custsupp(s, d)), f"SELECT dst AS v, count(*) AS degree FROM ({_CUSTSUPP}) GROUP BY dst")
_register(
    "degree_histogram",
    lambda s, d: prep.degree_histogram(graphs.copart(s, d)),
    _E + "SELECT degree, count(*) AS n FROM (SELECT src, count(*) AS degree FROM e GROUP BY src) GROUP BY degree",
)
_register(
    "row_pointers",
    lambda s, d: prep.row_pointers(graphs.copart(s, d)),
    _E + """SELECT src AS v, CAST(coalesce(sum(degree) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, degree
        FROM (SELECT src, count(*) AS degree FROM e GROUP BY src)""",
)
_register(
    "adjacency",
    lambda s, d: prep.adjacency(graphs.nationtrade(s, d)).select("src", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors")),
    _T + "SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors FROM e GROUP BY src",
)
_register("random_set", lambda s, d: _set(s, d), f"SELECT v FROM {_X}")
_register(
    "block_row_counts",
    lambda s, d: prep.block_row_counts(graphs.copart(s, d), 32),
    _E + "SELECT src // 32 AS brow, count(*) AS nnz FROM e GROUP BY 1",
)

# Packing.
for _w in (4, 8, 16, 32):
    _register(
        f"tile_pack_{_w}",
        lambda s, d, w=_w: tiles.pack(graphs.copart(s, d), w),
        _E + f"""SELECT src // {_w} AS brow, dst // {_w} AS bcol, CAST(src % {_w} AS INTEGER) AS r,
            bit_or(CAST(1 AS BIGINT) << CAST({_w - 1} - dst % {_w} AS INTEGER)) AS word FROM e GROUP BY 1, 2, 3""",
    )


def _halved(df: DataFrame) -> DataFrame:
    high, low = bits.halves("word")
    return df.select("brow", "bcol", "r", high.alias("high"), low.alias("low"))


_register(
    "tile_pack_64",
    lambda s, d: _halved(tiles.pack(graphs.copart(s, d), 64)),
    _E + """SELECT src // 64 AS brow, dst // 64 AS bcol, CAST(src % 64 AS INTEGER) AS r,
        CAST(coalesce(sum(DISTINCT CASE WHEN dst % 64 < 32 THEN CAST(1 AS BIGINT) << CAST(31 - dst % 64 AS INTEGER) END), 0) AS BIGINT) AS high,
        CAST(coalesce(sum(DISTINCT CASE WHEN dst % 64 >= 32 THEN CAST(1 AS BIGINT) << CAST(63 - dst % 64 AS INTEGER) END), 0) AS BIGINT) AS low
        FROM e GROUP BY 1, 2, 3""",
)
for _w in (4, 8, 16, 32):
    _register(
        f"tile_pack_col_{_w}",
        lambda s, d, w=_w: tiles.pack(graphs.copart(s, d), w, by="col"),
        _E + f"""SELECT src // {_w} AS brow, dst // {_w} AS bcol, CAST(dst % {_w} AS INTEGER) AS r,
            bit_or(CAST(1 AS BIGINT) << CAST({_w - 1} - src % {_w} AS INTEGER)) AS word FROM e GROUP BY 1, 2, 3""",
    )
_register(
    "tile_pack_col_64",
    lambda s, d: _halved(tiles.pack(graphs.copart(s, d), 64, by="col")),
    _E + """SELECT src // 64 AS brow, dst // 64 AS bcol, CAST(dst % 64 AS INTEGER) AS r,
        CAST(coalesce(sum(DISTINCT CASE WHEN src % 64 < 32 THEN CAST(1 AS BIGINT) << CAST(31 - src % 64 AS INTEGER) END), 0) AS BIGINT) AS high,
        CAST(coalesce(sum(DISTINCT CASE WHEN src % 64 >= 32 THEN CAST(1 AS BIGINT) << CAST(63 - src % 64 AS INTEGER) END), 0) AS BIGINT) AS low
        FROM e GROUP BY 1, 2, 3""",
)
_register(
    "vector_pack_32",
    lambda s, d: tiles.pack_set(_set(s, d), 32),
    f"SELECT v // 32 AS blk, bit_or(CAST(1 AS BIGINT) << CAST(31 - v % 32 AS INTEGER)) AS word FROM {_X} GROUP BY 1",
)
_register("tile_unpack_32", lambda s, d: tiles.unpack(tiles.pack(graphs.copart(s, d), 32), 32), _COPART)
_register("vector_unpack_32", lambda s, d: tiles.unpack_set(tiles.pack_set(_set(s, d), 32), 32), f"SELECT v FROM {_X}")
_register(
    "tile_align_8to32",
    lambda s, d: tiles.align(tiles.pack(graphs.copart(s, d), 8), 8, 32),
    _E + """, t AS (SELECT src // 8 AS brow, dst // 8 AS bcol, CAST(src % 8 AS INTEGER) AS r, bit_or(CAST(1 AS BIGINT) << CAST(7 - dst % 8 AS INTEGER)) AS word FROM e GROUP BY 1, 2, 3),
        k AS (SELECT brow, bcol, row_number() OVER (PARTITION BY brow ORDER BY bcol) - 1 AS k FROM (SELECT DISTINCT brow, bcol FROM t))
        SELECT brow, k // 4 AS slot, r, bit_or(word << CAST(24 - k % 4 * 8 AS INTEGER)) AS word FROM t JOIN k USING (brow, bcol) GROUP BY 1, 2, 3""",
)
_register(
    "block_coordinates",
    lambda s, d: tiles.expand_pointers(
        tiles.pack(graphs.nationtrade(s, d), 4).select("brow", "bcol").distinct().groupBy("brow").agg(F.count("*").alias("n")).select("brow", F.lit(0).alias("start"), F.col("n").alias("end"))
    ),
    _T + "SELECT brow, CAST(unnest(range(n)) AS BIGINT) AS at FROM (SELECT src // 4 AS brow, count(DISTINCT dst // 4) AS n FROM e GROUP BY 1)",
)


@query(
    _E + """, n AS (SELECT count(*) AS n FROM part), t AS (
        SELECT w AS width, count(*) AS tiles FROM (SELECT DISTINCT w, src // w AS i, dst // w AS j FROM e, (VALUES (4), (8), (16), (32), (64)) x(w)) GROUP BY w)
        SELECT width, tiles, 100.0::DOUBLE * tiles / (((n + width - 1) // width) * ((n + width - 1) // width)) AS percent FROM t, n"""
)
def tile_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return tiles.occupancy(graphs.copart(spark, d), graphs.parts(spark, d).count())


@query(
    _E + """, n AS (SELECT count(*) AS n FROM part), z AS (SELECT count(*) AS nnz FROM e), t AS (
        SELECT w AS width, count(*) AS tiles FROM (SELECT DISTINCT w, src // w AS i, dst // w AS j FROM e, (VALUES (4), (8), (16), (32), (64)) x(w)) GROUP BY w)
        SELECT width, (n + 1 + 2 * nnz) * 4 AS csr_bytes,
            tiles * width * CASE width WHEN 4 THEN 1 WHEN 8 THEN 1 WHEN 16 THEN 2 WHEN 32 THEN 4 ELSE 8 END + ((n + width - 1) // width + 1 + tiles) * 4 AS bsr_bytes
        FROM t, n, z"""
)
def footprint(spark: SparkSession, d: str) -> DataFrame:
    return tiles.footprint(graphs.copart(spark, d), graphs.parts(spark, d).count())


# Matrix by vector.
_BMV = _E + f"SELECT src AS v, count(*) AS val FROM e JOIN {_X} x ON dst = x.v GROUP BY src"
_register("bmv_count", lambda s, d: linalg.mxv(graphs.copart(s, d), _set(s, d)), _BMV)
for _w in (4, 8, 16, 32, 64):
    _register(f"bmv_packed_{_w}", lambda s, d, w=_w: linalg.mxv_packed(tiles.pack(graphs.copart(s, d), w), tiles.pack_set(_set(s, d), w), w), _BMV)
_register("bmv_staged", lambda s, d: linalg.mxv(graphs.copart(s, d), linalg.staged(_set(s, d))), _BMV)
_register("bmv_salted", lambda s, d: balance.salted_count(graphs.copart(s, d), _set(s, d)), _BMV)
_register("vxm_count", lambda s, d: linalg.vxm(_set(s, d), graphs.custsupp(s, d)), f"SELECT dst AS v, count(*) AS val FROM ({_CUSTSUPP}) WHERE src IN (SELECT v FROM {_X}) GROUP BY dst")
_register("bmv_or", lambda s, d: linalg.mxv_bool(graphs.copart(s, d), _set(s, d)), _E + f"SELECT DISTINCT dst AS v FROM e JOIN {_X} x ON src = x.v")
_register(
    "bmv_or_masked",
    lambda s, d: linalg.mxv_bool(graphs.copart(s, d), _set(s, d), mask=graphs.parts(s, d).where("v % 2 = 0")),
    _E + f"SELECT DISTINCT dst AS v FROM e JOIN {_X} x ON src = x.v WHERE dst % 2 <> 0",
)
_register(
    "mxv_minplus",
    lambda s, d: linalg.mxv(graphs.copart(s, d), _a(s, d), semiring.MIN_PLUS),
    _E + f"SELECT src AS v, min(val + 1) AS val FROM e JOIN {_A} x ON dst = x.v GROUP BY src",
)
_register(
    "mxv_minsecond",
    lambda s, d: linalg.mxv(graphs.copart(s, d), _a(s, d), semiring.MIN_SECOND),
    _E + f"SELECT src AS v, min(val) AS val FROM e JOIN {_A} x ON dst = x.v GROUP BY src",
)


@query(_E + f""", g AS (SELECT src AS u, count(*) AS n FROM e GROUP BY src)
    SELECT dst AS v, round(sum(0.85 / n * val), 8) AS val FROM e JOIN g ON src = u JOIN {_A} x ON src = x.v GROUP BY dst""")
def mxv_plustimes(spark: SparkSession, d: str) -> DataFrame:
    edges = graphs.copart(spark, d)
    degree = prep.out_degree(edges).withColumnRenamed("v", "src")
    weighted = edges.join(degree, "src").select("src", "dst", (F.lit(0.85) / F.col("degree")).alias("weight"))
    return linalg.vxm(_a(spark, d), weighted, semiring.PLUS_TIMES).select("v", F.round("val", 8).alias("val"))


# The same products on tiles.  copart has both directions of each edge, so its tiles serve as their own transposes.
_OR = _E + f"SELECT DISTINCT dst AS v FROM e JOIN {_X} x ON src = x.v"
for _w in (4, 8, 16, 32, 64):
    _register(
        f"bmv_or_packed_{_w}",
        lambda s, d, w=_w: tiles.unpack_set(linalg.mxv_bool_packed(tiles.pack(prep.transpose(graphs.copart(s, d)), w), tiles.pack_set(_set(s, d), w), None, w), w),
        _OR,
    )
    _register(
        f"bmv_or_masked_packed_{_w}",
        lambda s, d, w=_w: tiles.unpack_set(
            linalg.mxv_bool_packed(tiles.pack(prep.transpose(graphs.copart(s, d)), w), tiles.pack_set(_set(s, d), w), tiles.pack_set(graphs.parts(s, d).where("v % 2 = 0"), w), w), w
        ),
        _OR + " WHERE dst % 2 <> 0",
    )
    _register(
        f"mxv_minplus_packed_{_w}",
        lambda s, d, w=_w: linalg.mxv_values_packed(tiles.pack(graphs.copart(s, d), w), tiles.pack_values(_a(s, d), w), semiring.MIN_PLUS, w),
        ORACLES["mxv_minplus"],
    )
    _register(
        f"mxv_minsecond_packed_{_w}",
        lambda s, d, w=_w: linalg.mxv_values_packed(tiles.pack(graphs.copart(s, d), w), tiles.pack_values(_a(s, d), w), semiring.MIN_SECOND, w),
        ORACLES["mxv_minsecond"],
    )

    def _plustimes(spark: SparkSession, d: str, w: int = _w) -> DataFrame:
        """All entries of a column weigh the same, so the vector bears the weights."""
        edges = graphs.copart(spark, d)
        scaled = _a(spark, d).join(prep.out_degree(edges), "v").select("v", (F.col("val") * (F.lit(0.85) / F.col("degree"))).alias("val"))
        out = linalg.mxv_values_packed(tiles.pack(prep.transpose(edges), w), tiles.pack_values(scaled, w), semiring.PLUS_TIMES, w)
        return out.select("v", F.round("val", 8).alias("val"))

    _register(f"mxv_plustimes_packed_{_w}", _plustimes, ORACLES["mxv_plustimes"])


# Matrix by matrix.
_SUM = "SELECT count(*) AS total FROM l a JOIN l b ON a.dst = b.dst"
_register("bmm_sum", lambda s, d: linalg.mxm_sum(_lower(s, d), prep.transpose(_lower(s, d))), _L + _SUM)
_register("bmm_sum_pairs", lambda s, d: linalg.mxm_sum_pairs(_lower(s, d), prep.transpose(_lower(s, d))), _L + _SUM)


def _written_lower(spark: SparkSession, d: str) -> DataFrame:
    """The lower triangle, with repeated edges, which a product reads several times, written once."""
    return Workspace(spark, "lower").put(graphs.copart_lower(spark, d), "edges")


def _written_both(spark: SparkSession, d: str) -> DataFrame:
    """The whole graph, with repeated edges, made of the lower triangle."""
    lower = _written_lower(spark, d)
    return lower.unionByName(prep.transpose(lower))


@query(_L + "SELECT a.src, b.src AS dst, count(*) AS val FROM l a JOIN l b ON a.dst = b.dst GROUP BY 1, 2")
def bmm_numeric(spark: SparkSession, d: str) -> DataFrame:
    lower = _written_lower(spark, d)
    return linalg.mxm(lower, prep.transpose(lower), once=True)


@query(_E + "SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src")
def bmm_bool(spark: SparkSession, d: str) -> DataFrame:
    edges = _written_both(spark, d)
    return linalg.mxm_bool(edges, edges)


@query(_E + "SELECT a.src, b.dst, sum(CAST(a.src % 7 AS DOUBLE) * CAST(b.dst % 5 AS DOUBLE)) AS val FROM e a JOIN e b ON a.dst = b.src GROUP BY 1, 2")
def bmm_weighted(spark: SparkSession, d: str) -> DataFrame:
    edges = _written_both(spark, d)
    left, right = (edges.withColumn("weight", (F.col(c) % n).cast("double")) for c, n in (("src", 7), ("dst", 5)))
    return linalg.mxm_weighted(left, right, once=True)


for _w in (4, 8, 16, 32, 64):
    _register(f"bmm_sum_packed_{_w}", lambda s, d, w=_w: linalg.mxm_sum_packed(_lower(s, d), prep.transpose(_lower(s, d)), w), _L + _SUM)
_register(
    "bmm_symbolic",
    lambda s, d: (lambda lower: linalg.mxm_symbolic(lower, prep.transpose(lower), 32))(_written_lower(s, d)),
    _L + """, t AS (SELECT DISTINCT src // 32 AS i, dst // 32 AS j FROM l)
        SELECT i AS brow, count(*) AS tiles FROM (SELECT DISTINCT a.i, b.i AS k FROM t a JOIN t b USING (j)) GROUP BY i""",
)
_MASKED = _L + "SELECT count(*) AS total FROM l m JOIN l a ON a.src = m.src JOIN l b ON b.src = m.dst AND b.dst = a.dst"


@query(_L + "SELECT m.src, m.dst, count(*) AS val FROM l m JOIN l a ON a.src = m.src JOIN l b ON b.src = m.dst AND b.dst = a.dst GROUP BY 1, 2")
def bmm_masked(spark: SparkSession, d: str) -> DataFrame:
    lower = _written_lower(spark, d)
    return linalg.mxm_masked(lower, prep.transpose(lower), lower, once=True)


@query(_MASKED)
def bmm_masked_sum(spark: SparkSession, d: str) -> DataFrame:
    lower = _written_lower(spark, d)
    return linalg.mxm_masked_sum(lower, prep.transpose(lower), lower, once=True)


def _masked_packed(spark: SparkSession, d: str, width: int) -> DataFrame:
    lower = _written_lower(spark, d)
    return linalg.mxm_masked_sum_packed(lower, prep.transpose(lower), lower, width, once=True)


for _w in (4, 8, 16, 32, 64):
    _register(f"bmm_masked_packed_{_w}", lambda s, d, w=_w: _masked_packed(s, d, w), _MASKED)
_register(
    "dense_product",
    lambda s, d: linalg.dense_product(dense.generate(s, 32), dense.generate(s, 32)),
    """WITH m AS (SELECT i // 32 AS i, i % 32 AS j, CAST(i % 32 = 0 AS INTEGER) AS value FROM range(1024) t(i))
        SELECT DISTINCT a.i, b.j, 1 AS value FROM m a JOIN m b ON a.j = b.i WHERE a.value > 0 AND b.value > 0""",
)

# Element by element.
_FULL = f"SELECT coalesce(a.v, b.v) AS v, {{}} AS val FROM {_A} a FULL JOIN {_B} b ON a.v = b.v"
_INNER = f"SELECT a.v, {{}} AS val FROM {_A} a JOIN {_B} b ON a.v = b.v"
_register("ewise_or", lambda s, d: vector.union(_a(s, d), _b(s, d)), f"SELECT v FROM {_A} UNION SELECT v FROM {_B}")
_register("ewise_andnot", lambda s, d: vector.minus(_a(s, d), _b(s, d)), f"SELECT v FROM {_A} EXCEPT SELECT v FROM {_B}")
_register("ewise_and", lambda s, d: vector.common(_a(s, d), _b(s, d)), f"SELECT v FROM {_A} INTERSECT SELECT v FROM {_B}")
_register(
    "words_or",
    lambda s, d: vector.union_words(tiles.pack_set(_a(s, d), 32), tiles.pack_set(_b(s, d), 32)),
    f"SELECT v // 32 AS blk, bit_or(CAST(1 AS BIGINT) << CAST(31 - v % 32 AS INTEGER)) AS word FROM (SELECT v FROM {_A} UNION SELECT v FROM {_B}) GROUP BY 1",
)
_register(
    "words_andnot",
    lambda s, d: vector.minus_words(tiles.pack_set(_a(s, d), 32), tiles.pack_set(_b(s, d), 32)),
    f"SELECT v // 32 AS blk, bit_or(CAST(1 AS BIGINT) << CAST(31 - v % 32 AS INTEGER)) AS word FROM (SELECT v FROM {_A} EXCEPT SELECT v FROM {_B}) GROUP BY 1",
)
_register("ewise_min", lambda s, d: vector.minimum(_a(s, d), _b(s, d)), _FULL.format("least(a.val, b.val)"))
_register("ewise_less", lambda s, d: vector.less(_a(s, d), _b(s, d)), _FULL.format("CASE WHEN a.val IS NULL THEN 0 WHEN b.val IS NULL THEN 1 ELSE CAST(a.val < b.val AS INTEGER) END"))
_register("ewise_ne", lambda s, d: vector.differs(_a(s, d), _b(s, d)), _FULL.format("CAST(a.val IS DISTINCT FROM b.val AS INTEGER)"))
_register("ewise_add", lambda s, d: vector.add_value(_a(s, d), 5), f"SELECT v, val + 5 AS val FROM {_A}")
_register("ewise_sub", lambda s, d: vector.subtract(_a(s, d), _b(s, d)), _INNER.format("a.val - b.val"))
_register("ewise_mul", lambda s, d: vector.multiply(_a(s, d), _b(s, d)), _INNER.format("a.val * b.val"))
_register("assign_masked", lambda s, d: vector.keep_where(_a(s, d), _b(s, d)), f"SELECT a.v, a.val FROM {_A} a JOIN {_B} b ON a.v = b.v WHERE b.val <> 0")
_register("fill", lambda s, d: vector.fill(graphs.parts(s, d), 7), "SELECT p_partkey AS v, 7 AS val FROM part")
_register("iota", lambda s, d: vector.iota(s, graphs.parts(s, d).count()), "SELECT p_partkey AS v, p_partkey AS val FROM part")
_register("set_element", lambda s, d: vector.set_element(_a(s, d), 10, 99), f"SELECT v, CASE WHEN v = 10 THEN 99 ELSE val END AS val FROM {_A}")
_register("gather", lambda s, d: vector.gather(_a(s, d), _b(s, d)), f"SELECT b.v, a.val FROM {_B} b JOIN {_A} a ON b.val = a.v")
_register("scatter_min", lambda s, d: vector.scatter_min(_a(s, d), _b(s, d)), f"SELECT b.val AS v, min(a.val) AS val FROM {_B} b JOIN {_A} a ON b.v = a.v GROUP BY b.val")



def _reduce_masked(spark: SparkSession, d: str) -> DataFrame:
    """The mask goes into the product, so that no entry outside it is made; its entries are then added up."""
    lower = _written_lower(spark, d)
    inside = linalg.mxm_masked(lower, prep.transpose(lower), lower, once=True)
    return vector.total(inside).select(F.coalesce("total", F.lit(0)).cast("long").alias("total"))


# Reductions.
_register("reduce_popcount", lambda s, d: vector.popcount_words(tiles.pack_set(_set(s, d), 32)), f"SELECT count(*) AS total FROM {_X}")
_register("reduce_sum", lambda s, d: vector.total(_a(s, d)), f"SELECT CAST(sum(val) AS BIGINT) AS total FROM {_A}")
_register("reduce_finite", lambda s, d: vector.total_finite(_a(s, d), 60), f"SELECT CAST(sum(val) AS BIGINT) AS total FROM {_A} WHERE val < 60")
_register(
    "reduce_masked",
    _reduce_masked,
    _MASKED,
)
_register(
    "l2_difference",
    lambda s, d: vector.l2_difference(_a(s, d), _b(s, d)).select(F.round("l2", 6).alias("l2")),
    f"SELECT round(sqrt(sum(CAST((coalesce(a.val, 0) - coalesce(b.val, 0)) AS DOUBLE) ** 2)), 6) AS l2 FROM {_A} a FULL JOIN {_B} b ON a.v = b.v",
)
_register("nonzeros", lambda s, d: vector.nonzeros(_a(s, d)), f"SELECT count(*) AS nnz FROM {_A} WHERE val <> 0")
_register("distinct_labels", lambda s, d: vector.distinct_labels(_a(s, d)), f"SELECT count(DISTINCT val) AS labels FROM {_A}")
_register(
    "load_report",
    lambda s, d: vector.load_report(prep.block_row_counts(graphs.copart(s, d), 32).select(F.col("brow").alias("unit"), F.col("nnz").alias("load"))).select(
        "least", "most", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "busiest"
    ),
    _E + """, b AS (SELECT src // 32 AS unit, count(*) AS load FROM e GROUP BY 1)
        SELECT min(load) AS least, max(load) AS most, round(avg(load), 6) AS mean, round(stddev_pop(load), 6) AS deviation,
            (SELECT unit FROM b ORDER BY load DESC, unit DESC LIMIT 1) AS busiest FROM b""",
)
_register("top_vertices", lambda s, d: vector.top(prep.out_degree(graphs.copart(s, d)).withColumnRenamed("degree", "val"), 20), _E + "SELECT src AS v, count(*) AS val FROM e GROUP BY src ORDER BY val DESC, v LIMIT 20")

# Workloads.
_LOADS = _E + ", b AS (SELECT src // 32 AS brow, count(*) AS load FROM e GROUP BY 1) "


def _loads(spark: SparkSession, d: str) -> DataFrame:
    return prep.block_row_counts(graphs.copart(spark, d), 32).withColumnRenamed("nnz", "load")


_register(
    "workload_split",
    lambda s, d: balance.split(_loads(s, d), 1000),
    _LOADS + "SELECT brow, k * 1000 AS start, least(1000, load - k * 1000) AS load FROM (SELECT brow, load, CAST(unnest(range((load - 1) // 1000 + 1)) AS BIGINT) AS k FROM b)",
)
_register(
    "workload_merge",
    lambda s, d: balance.merge(_loads(s, d), 10_000),
    _LOADS.replace("WITH", "WITH RECURSIVE", 1) + """, n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY brow) AS k, brow, load FROM b),
        r AS (SELECT k, 0 AS unit, greatest(0, 10000 - load) AS room FROM n WHERE k = 1 UNION ALL
            SELECT n.k, unit + CAST(room = 0 OR load > room AND room < 10000 AS INTEGER), greatest(0, CASE WHEN room = 0 OR load > room AND room < 10000 THEN 10000 ELSE room END - load)
            FROM r JOIN n ON n.k = r.k + 1)
        SELECT CAST(unit AS BIGINT) AS unit, brow, CAST(0 AS BIGINT) AS start, CAST(load AS BIGINT) AS load FROM r JOIN n USING (k)""",
)
_CUT = _LOADS + """, p AS (SELECT brow, load AS n, CAST(coalesce(sum(load) OVER (ORDER BY brow ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM b),
    c AS (SELECT brow, n, before, CAST(unnest(range(before // 1000, (before + n - 1) // 1000 + 1)) AS BIGINT) AS unit FROM p),
    u AS (SELECT unit, brow, greatest(0, unit * 1000 - before) AS start, least(n, (unit + 1) * 1000 - before) - greatest(0, unit * 1000 - before) AS load FROM c) """
_register("workload_merge_split", lambda s, d: balance.merge_split(_loads(s, d), 1000), _CUT + "SELECT * FROM u")
_register(
    "workload_offsets",
    lambda s, d: balance.unit_offsets(balance.merge_split(_loads(s, d), 1000)).select("unit", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")),
    _CUT + """, z AS (SELECT unit, count(*) + 2 AS size FROM u GROUP BY unit)
        SELECT unit, CAST(sum(size) OVER (ORDER BY unit) - size AS BIGINT) AS start, CAST(sum(size) OVER (ORDER BY unit) AS BIGINT) AS "end" FROM z""",
)

# Verification.
_register(
    "compare_vectors",
    lambda s, d: verify.mismatches(_a(s, d), _b(s, d)),
    f"SELECT count(*) AS errors FROM {_A} a FULL JOIN {_B} b ON a.v = b.v WHERE abs(coalesce(a.val, 0) - coalesce(b.val, 0)) > 1e-6",
)
_register("compare_packed", lambda s, d: verify.packed_mismatches(tiles.pack_set(_set(s, d), 32), _set(s, d), 32), "SELECT CAST(0 AS BIGINT) AS errors")

# Algorithms.
_BFS = f"WITH RECURSIVE e AS MATERIALIZED ({_COPART}), b(v, l) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, l + 1 FROM b JOIN e ON e.src = b.v WHERE l < 40) "
_register("bfs_levels", lambda s, d: search.bfs(graphs.copart(s, d), 0)[0], _BFS + "SELECT v, min(l) AS level FROM b GROUP BY v")
for _w in (4, 32, 64):
    _register(f"bfs_packed_{_w}", lambda s, d, w=_w: search.bfs_packed(graphs.copart(s, d), 0, w)[0], ORACLES["bfs_levels"])
_register("bfs_counts", lambda s, d: search.bfs(graphs.copart(s, d), 0)[0].groupBy("level").agg(F.count("*").alias("n")), _BFS + "SELECT level, count(*) AS n FROM (SELECT v, min(l) AS level FROM b GROUP BY v) GROUP BY level")
_register("sssp_unit", lambda s, d: search.sssp(graphs.copart(s, d), 0)[0], _BFS + "SELECT v, CAST(min(l) AS BIGINT) AS dist FROM b GROUP BY v")


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return pagerank.pagerank(graphs.copart(spark, d), graphs.parts(spark, d), epsilon=0.0).ranks.select("v", F.round("rank", 10).alias("rank"))


_register(
    "pagerank10",
    _ranks,
    f"WITH e AS MATERIALIZED ({_COPART}), g AS MATERIALIZED (SELECT src AS u, count(*) AS n FROM e GROUP BY src), c AS (SELECT count(*) AS n FROM part), "
    "p0 AS (SELECT p_partkey AS v, 1.0::DOUBLE / c.n AS x FROM part, c), "
    + ", ".join(
        f"""p{k} AS MATERIALIZED (SELECT q.v, coalesce(y.s, 0) + 0.15::DOUBLE / c.n AS x FROM p{k - 1} q
            LEFT JOIN (SELECT e.dst, sum(0.85::DOUBLE / g.n * p.x) AS s FROM e JOIN g ON g.u = e.src JOIN p{k - 1} p ON p.v = e.src GROUP BY e.dst) y ON y.dst = q.v, c)"""
        for k in range(1, 11)
    )
    + " SELECT v, round(x, 10) AS rank FROM p10",
)
_CC = f"""WITH RECURSIVE e AS MATERIALIZED ({_COPART49}), r(v, root) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.v),
    c AS (SELECT v, min(root) AS val FROM r GROUP BY v) """


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(graphs.copart(spark, d, 49), graphs.parts(spark, d))


_register("cc_labels", _labels, _CC + "SELECT v, val FROM c")
_register(
    "cc_labels_whole",
    lambda s, d: components.connected_components(graphs.copart(s, d), graphs.parts(s, d)),
    _CC.replace(_COPART49, _COPART) + "SELECT v, val FROM c",
)
_register("cc_sizes", lambda s, d: _labels(s, d).groupBy("val").count().groupBy(F.col("count").alias("size")).agg(F.count("*").alias("n")), _CC + "SELECT size, count(*) AS n FROM (SELECT val, count(*) AS size FROM c GROUP BY val) GROUP BY size")
_register("cc_verify", lambda s, d: verify.check_components(graphs.copart(s, d, 49), _labels(s, d)), _CC + "SELECT CAST(0 AS BIGINT) AS errors, count(DISTINCT val) AS components FROM c")
_TRI = _E + "SELECT count(*) AS triangles FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst"
_register("triangles", lambda s, d: triangles.count(graphs.copart_lower(s, d)), _TRI)
_register("triangles_packed", lambda s, d: triangles.count_packed(graphs.copart_lower(s, d)), _TRI)
_register(
    "triangles_per_vertex",
    lambda s, d: triangles.per_vertex(graphs.copart_lower(s, d)),
    _E + """, t AS (SELECT a.src AS i, a.dst AS j, b.dst AS k FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst)
        SELECT v, count(*) AS triangles FROM (SELECT i AS v FROM t UNION ALL SELECT j FROM t UNION ALL SELECT k FROM t) GROUP BY v""",
)

# Files, written to the shared folder and read back.


def _file(spark: SparkSession) -> str:
    return Workspace(spark, "files").path("file")


def _mtx(spark: SparkSession, d: str, edges: DataFrame, **options) -> str:
    """A Matrix Market file of edges over all parts."""
    path, n = _file(spark), graphs.parts(spark, d).count()
    matrix_market.write(edges, path, n, n, comment="made from the tables", **options)
    return path


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return graphs.copart(spark, d).withColumn("weight", ((F.col("src") * 31 + F.col("dst")) % 17).cast("double"))


def _cells(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    cell = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("i"), F.expr(f"id % {cols}").alias("j"))
    return cell.withColumn("value", ((F.col("i") * 7 + F.col("j") * 3) % 5).cast("double"))


def _text(spark: SparkSession, lines: list[str]) -> str:
    path = _file(spark)
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "k int, value string").repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


_ENTRIES = "SELECT src, dst, CAST({} AS DOUBLE) AS weight FROM ({})"


@query(_L + ", n AS (SELECT count(*) AS n FROM part) SELECT 'MCPS' AS code, n AS rows, n AS cols, (SELECT count(*) FROM l) AS entries FROM n")
def mtx_header(spark: SparkSession, d: str) -> DataFrame:
    header = matrix_market.read_header(spark, _mtx(spark, d, graphs.copart(spark, d), symmetry="symmetric"))
    return spark.createDataFrame([(header.code, header.rows, header.cols, header.entries)], "code string, rows long, cols long, entries long")


_register("mtx_raw", lambda s, d: matrix_market.read_raw(s, _mtx(s, d, _weighted(s, d), field="real")), _ENTRIES.format("(src * 31 + dst) % 17", _COPART))
_register("mtx_symmetric", lambda s, d: matrix_market.read_raw(s, _mtx(s, d, graphs.copart(s, d), symmetry="symmetric")), _ENTRIES.format("1", _COPART))
_register("mtx_edges", lambda s, d: matrix_market.read_edges(s, _mtx(s, d, prep.tril(graphs.copart(s, d))), directed=2), _COPART)
_register("mtx_directed", lambda s, d: matrix_market.read_edges(s, _mtx(s, d, graphs.copart(s, d), symmetry="symmetric"), directed=1), _L + "SELECT * FROM l")
_register(
    "mtx_loops",
    lambda s, d: matrix_market.read_edges(s, _mtx(s, d, graphs.nationtrade(s, d)), drop_self_loops=False),
    _TRADE,
)
_register("mtx_cached", lambda s, d: matrix_market.cached(s, _mtx(s, d, graphs.copart(s, d)), Workspace(s, "cache").root), _COPART)


@query("SELECT i // 30 AS src, i % 30 AS dst, CAST((i // 30 * 7 + i % 30 * 3) % 5 AS DOUBLE) AS weight FROM range(1200) t(i) WHERE (i // 30 * 7 + i % 30 * 3) % 5 <> 0")
def mtx_array(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark)
    matrix_market.write_array(_cells(spark, 40, 30), path, 40, 30)
    return matrix_market.read_raw(spark, path)


for _kind, _least, _sign in (("symmetric", "greatest(i // 40, i % 40) * 7 + least(i // 40, i % 40) * 3", 1), ("skew-symmetric", "greatest(i // 40, i % 40) * 7 + least(i // 40, i % 40) * 3", -1)):

    def _array(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        path = _file(spark)
        matrix_market.write_array(_cells(spark, 40, 40), path, 40, 40, kind)
        return matrix_market.read_raw(spark, path)

    _register(
        f"mtx_array_{_kind.partition('-')[0]}",
        _array,
        f"""SELECT i // 40 AS src, i % 40 AS dst, CAST(({_least}) % 5 * CASE WHEN i // 40 < i % 40 THEN {_sign} ELSE 1 END AS DOUBLE) AS weight
            FROM range(1600) t(i) WHERE ({_least}) % 5 <> 0 {"AND i // 40 <> i % 40" if _sign < 0 else ""}""",
    )


@query("SELECT i // 30 AS i, i % 30 AS j, CAST((i // 30 * 7 + i % 30 * 3) % 5 AS DOUBLE) AS value FROM range(1200) t(i)")
def dense_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark)
    dense.write(_cells(spark, 40, 30), path)
    return dense.read(spark, path, 30)


@query("SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(value AS DOUBLE) AS value FROM (VALUES (0, 2, 1), (0, 3, 0), (1, 2, 0), (1, 3, 1), (2, 0, 2), (2, 1, 0), (3, 0, 0), (3, 1, 3), (2, 4, 0), (2, 5, 4), (3, 4, 5), (3, 5, 0)) t(i, j, value)")
def bsr_csv(spark: SparkSession, d: str) -> DataFrame:
    return dense.read_blocks(spark, _text(spark, ["4", "0,1,3,3"]), _text(spark, ["3", "1", "0", "2"]), _text(spark, ["1,0,0,1", "2,0,0,3", "0,4,5,0"]), 2)
