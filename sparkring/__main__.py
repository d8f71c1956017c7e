"""Command line: python -m sparkring COMMAND FILE.mtx [DIRECTED] [--width W] [--most N] [--cache FOLDER]

bfs, cc and tc read clean edges (DIRECTED: 0 follows the file, 1 takes it as it is, 2 mirrors it); sssp, pr, bmv and bmm
read all entries.  bmv multiplies by the set of every second vertex, plain and packed, and compares; bmm adds up the
product of the lower triangle with its transpose in three ways.  Results go to standard output.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import balance, linalg, prep, tiles, vector, verify
from .plans import components, pagerank, search, triangles
from .sources import matrix_market

CLEAN, RAW = ("bfs", "cc", "tc"), ("sssp", "pr", "bmv", "bmm")


def _vertices(spark: SparkSession, header: matrix_market.Header) -> DataFrame:
    return spark.range(max(header.rows, header.cols)).select(F.col("id").alias("v"))


def run(spark: SparkSession, command: str, path: str, directed: int = 0, width: int = 32, most: int = 1024, cache: str | None = None) -> list[str]:
    """The lines that a command prints."""
    header = matrix_market.read_header(spark, path)
    if command in CLEAN:
        edges = matrix_market.cached(spark, path, cache, directed) if cache else matrix_market.read_edges(spark, path, directed)
    elif command in RAW:
        edges = prep.pattern(matrix_market.read_raw(spark, path))
    else:
        raise ValueError(f"unknown command {command}")
    domain, n = _vertices(spark, header), max(header.rows, header.cols)
    size = tiles.footprint(edges, n, (width,)).first()
    out = [
        f"{header.rows} x {header.cols}, {edges.count()} edges",
        f"tiles of width {width}: {tiles.tile_count(edges, width).first()[0]}; compressed rows {tiles.readable(size['csr_bytes'])}, tiles {tiles.readable(size['bsr_bytes'])}" if size else "no tiles",
    ]
    timer = verify.Timer()
    if command == "bfs":
        found, counts = timer.run(lambda: search.bfs(edges, 0))
        out += [f"round {i}: {c} new" for i, c in enumerate(counts, 1)] + [f"{found.count()} reached in {len(counts)} rounds"]
    elif command == "sssp":
        found, rounds = timer.run(lambda: search.sssp(edges, 0))
        far = found.agg(F.count("*"), F.max("dist")).first()
        out.append(f"{far[0]} reached, farthest {far[1]}, {rounds} rounds")
    elif command == "pr":
        ranks = timer.run(lambda: pagerank.pagerank(edges, domain))
        out += [f"{ranks.rounds} rounds, error {ranks.error:.6g}", *(f"{r['v']}: {r['val']:.9f}" for r in vector.top(ranks.ranks.withColumnRenamed("rank", "val"), 10).collect())]
    elif command == "cc":
        labels = timer.run(lambda: components.connected_components(edges, domain))
        checked = verify.check_components(edges, labels).first()
        out.append(f"{checked['components']} components, {checked['errors']} errors")
    elif command == "tc":
        both = prep.symmetrize(edges)
        out.append(f"{timer.run(lambda: triangles.count(both).first()[0])} triangles")
    elif command == "bmv":
        members = prep.every(domain, F.col("v") % 2 == 0)
        plain = linalg.mxv(edges.distinct(), members)
        packed = linalg.mxv_packed(tiles.pack(edges, width), tiles.pack_set(members, width), width)
        out.append(f"sum {timer.run(lambda: plain.agg(F.sum('val')).first()[0])}, {verify.mismatches(plain, packed).first()[0]} entries differ when packed")
        loads = prep.block_row_counts(edges, width).withColumnRenamed("nnz", "load")
        report = vector.load_report(balance.merge_split(loads, most).groupBy("unit").agg(F.sum("load").alias("load"))).first()
        out.append(f"units of at most {most}: least {report['least']}, most {report['most']}, mean {report['mean'] or 0:.2f}")
    else:
        lower = prep.tril(edges).distinct()
        other = prep.transpose(lower)
        eager = timer.run(lambda: linalg.mxm_sum(lower, other).first()[0])
        out.append(f"sum {eager}, by pairs {linalg.mxm_sum_pairs(lower, other).first()[0]}, at the triangle's places {linalg.mxm_masked_sum_packed(lower, other, lower, width).first()[0]}")
    return [*out, f"{timer.report()['mean']:.3f} s"]


def main() -> None:
    parser = argparse.ArgumentParser(prog="sparkring", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=(*CLEAN, *RAW))
    parser.add_argument("file")
    parser.add_argument("directed", nargs="?", type=int, default=0, choices=(0, 1, 2))
    parser.add_argument("--width", type=int, default=32, choices=(4, 8, 16, 32, 64))
    parser.add_argument("--most", type=int, default=1024)
    parser.add_argument("--cache")
    args = parser.parse_args()
    spark = SparkSession.builder.appName(f"sparkring {args.command}").getOrCreate()
    print("\n".join(run(spark, args.command, args.file, args.directed, args.width, args.most, args.cache)))


if __name__ == "__main__":
    main()
