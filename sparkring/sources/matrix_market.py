"""Matrix Market files: coordinate matrices as edges, through Spark's text source and sink."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prep
from .lines import numbered

FORMATS = ("coordinate", "array")
FIELDS = ("pattern", "integer", "real", "complex")
SYMMETRIES = ("general", "symmetric", "hermitian", "skew-symmetric")


@dataclass(frozen=True)
class Header:
    format: str
    field: str
    symmetry: str
    rows: int
    cols: int
    entries: int

    @property
    def code(self) -> str:
        """Four letters: matrix; coordinate or array; the field; the symmetry."""
        return "M" + {"coordinate": "C", "array": "A"}[self.format] + self.field[0].upper() + {"general": "G", "symmetric": "S", "hermitian": "H", "skew-symmetric": "K"}[self.symmetry]


def parse_header(lines: list[str]) -> Header:
    """The banner and the size line; ValueError if the file is not a matrix that the format allows."""
    words = lines[0].strip().lower().split() if lines else []
    if len(words) != 5 or words[0] != "%%matrixmarket" or words[1] != "matrix":
        raise ValueError("not a Matrix Market banner")
    form, field, symmetry = words[2:]
    field = "real" if field == "double" else field
    symmetry = "skew-symmetric" if symmetry == "skew" else symmetry
    if form not in FORMATS or field not in FIELDS or symmetry not in SYMMETRIES:
        raise ValueError(f"unknown kind of matrix: {' '.join(words[2:])}")
    if form == "array" and field == "pattern":
        raise ValueError("an array has values")
    if symmetry == "hermitian" and field != "complex":
        raise ValueError("only complex matrices are hermitian")
    if field == "pattern" and symmetry == "skew-symmetric":
        raise ValueError("a pattern is not skew-symmetric")
    for line in lines[1:]:
        text = line.strip()
        if text and not text.startswith("%"):
            size = [int(x) for x in text.split()]
            if len(size) != (3 if form == "coordinate" else 2):
                raise ValueError(f"not a size line: {text}")
            return Header(form, field, symmetry, size[0], size[1], size[2] if len(size) == 3 else size[0] * size[1])
    raise ValueError("no size line")


_BANNER = "%%matrixmarket"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file, or of a folder's files, that are neither empty nor comments."""
    return spark.read.text(path).select(F.trim("value").alias("line"), "_metadata.file_path").where("line <> '' and not startswith(line, '%')")


def read_header(spark: SparkSession, path: str) -> Header:
    """The banner, and the first line of its file that is no comment, however many comments stand between."""
    banner = spark.read.text(path).select("value", "_metadata.file_path").where(F.startswith(F.lower("value"), F.lit(_BANNER))).take(1)
    if not banner:
        raise ValueError("not a Matrix Market banner")
    size = _lines(spark, banner[0]["file_path"]).select("line").take(1)
    return parse_header([banner[0]["value"], *(r["line"] for r in size)])


def read_raw(spark: SparkSession, path: str, mirror: bool = True) -> DataFrame:
    """(src, dst, weight) of all entries, 0-based; symmetric files are mirrored off the diagonal, nothing else changes.

    Patterns weigh 1.  Complex matrices are refused.  Comments and the size line are told apart by their text, so the
    file may be split among tasks.  One pass checks the entries: lines of another kind, places outside the matrix and a
    number other than the declared one are a ValueError.
    """
    header = read_header(spark, path)
    if header.field == "complex":
        raise ValueError("complex values are not supported")
    if header.format == "array":
        return _mirrored(_read_array(spark, path, header), header, mirror)
    size, n = f"{header.rows} {header.cols} {header.entries}", 2 if header.field == "pattern" else 3
    entries = _lines(spark, path).select(F.split("line", r"\s+").alias("w"))
    sized = F.array_join("w", " ") == size
    number = lambda k: F.expr(f"try_cast(element_at(w, {k}) as {'long' if k < 3 else 'double'})")
    good = (F.size("w") == n) & number(1).between(1, header.rows) & number(2).between(1, header.cols)
    good = F.coalesce(good if n == 2 else good & number(3).isNotNull(), F.lit(False))
    alike = sized & good  # an entry may read like the size line
    found = entries.agg(F.count_if(good).alias("good"), F.count_if(~good & ~sized).alias("bad"), F.count_if(alike).alias("alike")).first()
    again = max(0, found["alike"] - 1)
    if found["bad"] or found["good"] - found["alike"] + again != header.entries:
        raise ValueError(f"{header.entries} entries are declared; {found['good'] - found['alike'] + again} are good and {found['bad']} are not")
    entries = entries.where(~sized)
    weight = F.lit(1.0) if n == 2 else number(3)
    out = entries.select((number(1) - 1).alias("src"), (number(2) - 1).alias("dst"), weight.alias("weight"))
    if again:
        row = [(header.rows - 1, header.cols - 1, float(header.entries))]
        out = out.unionByName(spark.createDataFrame(row, "src long, dst long, weight double").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(again)))).drop("k"))
    return _mirrored(out, header, mirror)


def _mirrored(out: DataFrame, header: Header, mirror: bool) -> DataFrame:
    if not mirror or header.symmetry == "general":
        return out
    sign = -1 if header.symmetry == "skew-symmetric" else 1
    return out.unionByName(out.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * sign).alias("weight")))


def _read_array(spark: SparkSession, path: str, header: Header) -> DataFrame:
    """Dense values of one file, one a line, column by column; the non-zeros are the entries.

    Symmetric arrays have the columns of the lower triangle, skew-symmetric ones without the diagonal.
    """
    n, skew = header.rows, header.symmetry == "skew-symmetric"
    if header.symmetry != "general" and n != header.cols:
        raise ValueError("a symmetric matrix is square")
    declared = n * header.cols if header.symmetry == "general" else n * (n - 1) // 2 if skew else n * (n + 1) // 2
    values = numbered(_lines(spark, path).select(F.expr("try_cast(line as double)").alias("weight"), "line")).where("k > 0").withColumn("k", F.col("k") - 1)
    found = values.agg(F.count("*").alias("n"), F.count("weight").alias("good")).first()
    if found["n"] != declared or found["good"] != declared:
        raise ValueError(f"{declared} values are declared; there are {found['good']} in {found['n']} lines")
    if header.symmetry == "general":
        place = F.expr(f"cast(k % {n} as long)").alias("src"), F.expr(f"cast(k div {n} as long)").alias("dst")
        return values.where("weight <> 0").select(*place, "weight")
    # Column j begins at j * (2 * m - j + 1) / 2 with m values in the first one; a root finds it but for rounding.
    m = n - 1 if skew else n
    begin = lambda j: F.expr(f"cast(({j}) * ({2 * m + 1} - ({j})) div 2 as long)")
    guess = values.where("weight <> 0").withColumn("j", F.expr(f"cast(floor(({2 * m + 1} - sqrt(greatest(0D, {2 * m + 1}D * {2 * m + 1}D - 8D * k))) / 2) as long)"))
    exact = guess.withColumn("j", F.when(begin("j") > F.col("k"), F.col("j") - 1).when(begin("j + 1") <= F.col("k"), F.col("j") + 1).otherwise(F.col("j")))
    return exact.select((F.col("k") - begin("j") + F.col("j") + int(skew)).alias("src"), F.col("j").alias("dst"), "weight")


def read_edges(spark: SparkSession, path: str, directed: int = 0, drop_self_loops: bool = True) -> DataFrame:
    """Clean edges (src, dst).  directed: 0 follows the file, 1 takes entries as they are, 2 mirrors them."""
    if directed not in (0, 1, 2):
        raise ValueError("directed is 0, 1 or 2")
    header = read_header(spark, path)
    raw = read_raw(spark, path, mirror=False)
    mirror = directed == 2 or directed == 0 and header.symmetry != "general"
    return prep.clean(raw, directed=not mirror, drop_self_loops=drop_self_loops)


def cached(spark: SparkSession, path: str, cache: str, directed: int = 0, drop_self_loops: bool = True) -> DataFrame:
    """Clean edges by way of a Parquet copy, which is made if it is not there (its name tells how they were cleaned)."""
    folder = f"{cache.rstrip('/')}/{path.rstrip('/').rsplit('/', 1)[-1]}.{directed}.{'nl' if drop_self_loops else 'l'}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        read_edges(spark, path, directed, drop_self_loops).write.mode("overwrite").parquet(folder)
    return spark.read.schema("src long, dst long").parquet(folder)


def write(edges: DataFrame, path: str, rows: int, cols: int, field: str = "pattern", comment: str = "", symmetry: str = "general") -> None:
    """A coordinate matrix: one folder of part files, of which the first has the header.

    The parts follow each other in (src, dst) order; joined, they are one file.  Of a symmetric matrix only the lower
    triangle is written.
    """
    if symmetry not in ("general", "symmetric"):
        raise ValueError("symmetry is general or symmetric")
    if symmetry == "symmetric":
        edges = prep.tril(edges)
    if field not in ("pattern", "integer", "real"):
        raise ValueError("field is pattern, integer or real")
    spark = edges.sparkSession
    names = [(F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string")]
    if field != "pattern":
        names.append(F.col("weight").cast("long" if field == "integer" else "double").cast("string"))
    entries = edges.select(F.lit(1).alias("k"), "src", "dst", F.concat_ws(" ", *names).alias("value"))
    text = [f"%%MatrixMarket matrix coordinate {field} {symmetry}", *([f"% {comment}"] if comment else []), f"{rows} {cols} {edges.count()}"]
    head = spark.createDataFrame([(0, i, 0, x) for i, x in enumerate(text)], "k int, src long, dst long, value string")
    head.unionByName(entries).orderBy("k", "src", "dst").select("value").write.mode("overwrite").text(path)


def write_array(matrix: DataFrame, path: str, rows: int, cols: int, symmetry: str = "general") -> None:
    """A dense matrix (i, j, value): one value a line, column by column, in one file; symmetric ones as their lower triangle."""
    spark = matrix.sparkSession
    if symmetry != "general":
        matrix = matrix.where("i > j" if symmetry == "skew-symmetric" else "i >= j")
    head = spark.createDataFrame([(0, 0, 0, f"%%MatrixMarket matrix array real {symmetry}"), (0, 0, 1, f"{rows} {cols}")], "p int, j long, i long, value string")
    body = matrix.select(F.lit(1).alias("p"), F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i"), F.col("value").cast("double").cast("string").alias("value"))
    head.unionByName(body).repartition(1).sortWithinPartitions("p", "j", "i").select("value").write.mode("overwrite").text(path)
