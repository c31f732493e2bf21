"""Command line: beta (one-off, partial, partial-report, merge-partial) and faith."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from phylospark import api
from phylospark.operators import diversity, stripes
from phylospark.sources import store


def _square(rows, samples, path: str) -> None:
    """A tab-separated square matrix, as text; it is dense, so it is made on the driver."""
    ids = [r["sample_id"] for r in samples.orderBy("ord").select("sample_id").collect()]
    with open(path, "w", encoding="utf-8") as out:
        out.write("\t".join(["", *ids]) + "\n")
        for name, line in zip(ids, store.dense(rows, len(ids)).tolist(), strict=True):
            out.write("\t".join([name, *map(repr, line)]) + "\n")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="phylospark")
    commands = parser.add_subparsers(dest="command", required=True)
    beta = commands.add_parser("beta")
    faith = commands.add_parser("faith")
    for p in (beta, faith):
        p.add_argument("-i", dest="table", required=True)
        p.add_argument("-t", dest="tree")
        p.add_argument("-o", dest="out")
    beta.add_argument("-m", dest="method", default="unweighted")
    beta.add_argument("-a", dest="alpha", type=float, default=1.0)
    beta.add_argument("-f", dest="bypass", action="store_true")
    beta.add_argument("-n", dest="threads", type=int, default=1)
    beta.add_argument("--vaw", action="store_true")
    beta.add_argument("--mode", choices=("one-off", "partial", "partial-report", "merge-partial"), default="one-off")
    beta.add_argument("--start", type=int, default=0)
    beta.add_argument("--stop", type=int)
    beta.add_argument("--partial-pattern")
    beta.add_argument("--n-partials", type=int, default=1)
    beta.add_argument("--report-bare", action="store_true")
    beta.add_argument("--format", "-r", default="ascii")
    beta.add_argument("--n-substeps", type=int, default=1)
    beta.add_argument("--pcoa", type=int, default=10)
    beta.add_argument("--diskbuf", default="")
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("phylospark").getOrCreate()
    if args.command == "faith":
        rows = api.faith_pd(args.table, args.tree).orderBy("sample_id").collect()
        with open(args.out, "w", encoding="utf-8") as out:
            out.writelines(f"{r['sample_id']}\t{r['faith_pd']!r}\n" for r in rows)
        return 0
    if args.mode == "partial-report":
        from phylospark.sources.tables import read_table

        n = read_table(spark, args.table).samples.count()
        if not args.report_bare:
            print(f"Total samples: {n}\nTotal stripes: {stripes.count(n)}")
        for a, b in stripes.report(n, args.n_partials):
            print(f"{a}\t{b}" if args.report_bare else f"--start {a} --stop {b}")
        return 0
    if args.mode == "one-off" and args.format != "ascii":
        api.run_to_store(args.table, args.tree, args.out, args.method, args.pcoa, alpha=args.alpha, variance_adjusted=args.vaw, bypass_tips=args.bypass, format=args.format)
        return 0
    table, closure = api.load(args.table, args.tree)
    if args.mode == "partial":
        stop = stripes.count(table.samples.count()) if args.stop is None else args.stop
        stripes.partial(table.abundance, closure, table.samples, args.start, stop, args.method, alpha=args.alpha, variance_adjusted=args.vaw, bypass_tips=args.bypass).write.parquet(args.out)
        return 0
    if args.mode == "merge-partial":
        n = table.samples.count()
        rows = stripes.merge([spark.read.parquet(args.partial_pattern)], n)
    else:
        rows = diversity.beta(table.abundance, closure, table.samples, args.method, args.alpha, args.vaw, args.bypass)
    _square(rows.where(F.col("rep") == 0), table.samples, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
