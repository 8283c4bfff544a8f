"""python -m skein.cli index|resolve|query: index a tree, link repositories, run a catalogue query."""

from __future__ import annotations

import argparse
import inspect
import json

from pyspark.sql import SparkSession

from skein.graph import CodeGraph, conform
from skein.operators import callgraph, orm, perf, resolve, security

QUERIES = {n: f for m in (callgraph, orm, security, perf) for n, f in vars(m).items()
           if inspect.isfunction(f) and f.__module__ == m.__name__ and not n.startswith("_") and next(iter(inspect.signature(f).parameters), "") == "g"}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skein")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index", help="index a source tree into a graph folder")
    a.add_argument("root")
    a.add_argument("graph")
    a.add_argument("--repo", required=True)
    a.add_argument("--branch", default="master")
    a = sub.add_parser("resolve", help="link requests to endpoints across repositories")
    a.add_argument("graph")
    a.add_argument("out")
    a = sub.add_parser("query", help="run a query; parameters as name=value")
    a.add_argument("graph")
    a.add_argument("name", choices=sorted(QUERIES))
    a.add_argument("params", nargs="*")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("skein").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "index":
        from skein.sources.index import index_repo

        index_repo(spark, args.root, args.repo, args.branch).write(args.graph)
    elif args.command == "resolve":
        g = CodeGraph.read(spark, args.graph)
        edges, depends, counts = resolve.resolve_cross_repo(g)
        g.with_tables(calls_rest=conform(edges, "calls_rest"), depends_on=conform(depends, "depends_on")).write(args.out)
        print(json.dumps(counts.first().asDict()))
    else:
        f = QUERIES[args.name]
        given = {}
        for x in args.params:
            k, _, v = x.partition("=")
            old = inspect.signature(f).parameters[k].default
            given[k] = v.lower() in ("1", "true", "yes") if isinstance(old, bool) else int(v) if isinstance(old, int) else v
        out = f(CodeGraph.read(spark, args.graph), **given)
        for df in out if isinstance(out, tuple) else (out,):
            for row in df.toJSON().toLocalIterator():
                print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
