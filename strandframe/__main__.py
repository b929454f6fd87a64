"""Command line: build-index, list, fetch, query and decompose over a stored collection."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.operators import bundles as B
from strandframe.operators.shimmers import ShimmerSpec
from strandframe.plans.pangenome import Pangenome
from strandframe.session import stored
from strandframe.sources import readers as R, writers as W


def _specification(p: argparse.ArgumentParser, w: int, k: int, r: int, min_span: int) -> None:
    for name, value in (("w", w), ("k", k), ("r", r), ("min-span", min_span)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--windowed", action="store_true", help="windowed minimizers instead of a sketch")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandframe", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build-index", help="sequences of FASTA and FASTQ files with their pair index")
    p.add_argument("store"), p.add_argument("files", nargs="+")
    _specification(p, 80, 56, 4, 64)
    p = sub.add_parser("list", help="the sequences of a collection: sid, source, name, length")
    p.add_argument("store"), p.add_argument("out")
    p = sub.add_parser("fetch", help="the bases of listed regions as FASTA")
    p.add_argument("store"), p.add_argument("regions"), p.add_argument("out")
    p = sub.add_parser("query", help="the regions that match queries: OUT.hit, and their bases in OUT.fa")
    p.add_argument("store"), p.add_argument("queries"), p.add_argument("out")
    p.add_argument("--gap-penalty", type=float, default=0.025), p.add_argument("--merge", type=int, default=100_000), p.add_argument("--max-count", type=int, default=128)
    p.add_argument("--only-summary", action="store_true")
    p = sub.add_parser("decompose", help="principal bundles along the sequences: OUT.bed, OUT.ctg.summary, OUT.bundles and OUT.gfa")
    p.add_argument("store"), p.add_argument("out")
    p.add_argument("--include", help="a file with the names of the sequences to take, one a line")
    p.add_argument("--min-cov", type=int, default=0), p.add_argument("--min-branch", type=int, default=8), p.add_argument("--min-length", type=int, default=2500), p.add_argument("--merge-distance", type=int, default=10_000)
    return top


def included(sequences: DataFrame, names: DataFrame) -> DataFrame:
    """The sequences whose name is listed in ``names`` (value)."""
    return sequences.join(names.select(F.trim("value").alias("name")), "name", "left_semi").select(*sequences.columns)


def run(spark: SparkSession, arguments: list[str]) -> None:
    a = parser().parse_args(arguments)
    if a.command == "build-index":
        Pangenome.from_files(spark, a.files, ShimmerSpec(a.w, a.k, a.r, a.min_span, not a.windowed)).save(a.store)
        return
    p = Pangenome.from_store(spark, a.store)
    if a.command == "list":
        W.tsv(p.catalog.select("sid", F.coalesce("source", F.lit("None")).alias("source"), "name", "len"), a.out)
    elif a.command == "fetch":
        W.fasta(p.fetch(R.regions(spark, a.regions)), a.out, "label")
    elif a.command == "query":
        hits = stored(p.hit_table(R.sequences(spark, [a.queries]), a.merge, penalty=a.gap_penalty, max_count=a.max_count, max_query=a.max_count, max_target=a.max_count))
        W.hits_table(hits, f"{a.out}.hit")
        if not a.only_summary:
            W.fasta(p.hit_sequences(hits), f"{a.out}.fa")
    else:
        if a.include:
            p = Pangenome(included(p.sequences, spark.read.text(a.include)), p.spec)
        bundles = stored(p.bundles(a.min_cov, a.min_branch))
        bed = stored(p.bundle_bed(bundles, a.min_length, a.merge_distance))
        W.bundle_bed_lines(bed).write.mode("overwrite").text(f"{a.out}.bed")
        W.tsv(B.contig_summary(bed), f"{a.out}.ctg.summary", header=True)
        bundles.write.mode("overwrite").parquet(f"{a.out}.bundles")
        p.write_gfa(f"{a.out}.gfa", a.min_cov, bundles)


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("strandframe").getOrCreate()
    run(spark, sys.argv[1:])
    spark.stop()


if __name__ == "__main__":
    main()
