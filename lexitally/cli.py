"""Command line entry points matching the reference's programs.

    python -m lexitally.cli wordcount IN OUT [--rule letters] [--files N] [--overwrite]
    python -m lexitally.cli count PATH [--rule whitespace] [--recursive]
    python -m lexitally.cli results IN OUT [--format parquet|csv] [--overwrite]

``wordcount`` is the per-word job: recursive text scan, letter rule,
``word<TAB>count`` files hash-partitioned by word and sorted (one file per
reducer), refusing an existing output folder unless ``--overwrite``.
``count`` prints the global token total.  ``results`` reads result CSVs
written with any of the known header spellings into one canonical schema.  The
timing experiment is ``scripts/experiment.py``.
"""

from __future__ import annotations

import argparse

from .functions.tokenize import LETTERS, RULES, WHITESPACE


def cmd_wordcount(spark, args) -> None:
    from .operators.wordcount import word_freq
    from .sinks.files import reducer_session, write_word_counts
    from .sources.text import read_lines

    n_files = args.files or spark.sparkContext.defaultParallelism
    reducer_session(spark, n_files)      # the command owns its session
    freq = word_freq(read_lines(spark, args.input, recursive=True), "value", args.rule)
    write_word_counts(freq, args.output, None,
                      mode="overwrite" if args.overwrite else "errorifexists")


def cmd_count(spark, args) -> None:
    from .operators.wordcount import word_total
    from .sources.text import read_lines

    total = word_total(read_lines(spark, args.path, args.recursive), "value", args.rule)
    print(total.first()["word_count"])


def cmd_results(spark, args) -> None:
    from .sources.results import read_results

    table = read_results(spark, args.input)
    writer = table.write.mode("overwrite" if args.overwrite else "errorifexists")
    if args.format == "csv":
        writer.option("header", "true").csv(args.output)
    else:
        writer.parquet(args.output)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="lexitally")
    ap.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    sub = ap.add_subparsers(dest="cmd", required=True)

    w = sub.add_parser("wordcount", help="per-word counts to key<TAB>count files")
    w.add_argument("input")
    w.add_argument("output")
    w.add_argument("--rule", choices=RULES, default=LETTERS)
    w.add_argument("--files", type=int, default=0, help="output files (reducers)")
    w.add_argument("--overwrite", action="store_true")
    w.set_defaults(fn=cmd_wordcount)

    c = sub.add_parser("count", help="global token total")
    c.add_argument("path")
    c.add_argument("--rule", choices=RULES, default=WHITESPACE)
    c.add_argument("--recursive", action="store_true")
    c.set_defaults(fn=cmd_count)

    r = sub.add_parser("results", help="result CSVs (any header spelling) to one schema")
    r.add_argument("input")
    r.add_argument("output")
    r.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    r.add_argument("--overwrite", action="store_true")
    r.set_defaults(fn=cmd_results)

    args = ap.parse_args(argv)
    from .session import build_session
    spark = build_session(args.master, "lexitally-cli")
    try:
        args.fn(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
