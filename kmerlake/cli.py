"""Command line: python -m kmerlake.cli -x index -i a.fq b.fq -o a.txt b.txt cleans; with --search hits, it searches the index."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from kmerlake.plans.clean import clean_files, search_files
from kmerlake.sources import fastx, index_file


def parsed(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="kmerlake", description="Clean sequence files: one sequence a line, at least k letters each.")
    p.add_argument("-x", "--index", help="index file, from which k is taken")
    p.add_argument("-k", type=int, help="k, where no index is given")
    p.add_argument("-i", nargs="+", default=[], help="input files")
    p.add_argument("-o", nargs="+", default=[], help="output files")
    p.add_argument("-if", dest="input_list", help="file that lists inputs, one a line")
    p.add_argument("-of", dest="output_list", help="file that lists outputs, one a line")
    p.add_argument("--search", metavar="HITS", help="write the index's row of every k-mer of the inputs to this Parquet folder, in place of clean files")
    args = p.parse_args(argv)
    if not args.index and args.k is None:
        p.error("an index or k is needed")
    if args.search and not args.index:
        p.error("a search needs an index")
    return args


def main(argv: list[str] | None = None) -> int:
    args = parsed(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("kmerlake").getOrCreate()
    listed = lambda path: [r["path"] for r in fastx.read_path_list(spark, path).collect()] if path else []
    try:
        if args.search:
            index, k = index_file.read(spark, args.index)
            search_files(spark, args.i + listed(args.input_list), index, k, args.search)
            return 0
        k = args.k if args.k is not None else index_file.metadata(spark, args.index)["k"]
        clean_files(spark, args.i + listed(args.input_list), args.o + listed(args.output_list), k).show(truncate=False)
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
