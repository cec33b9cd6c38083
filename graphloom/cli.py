"""Command line: index a file or folder, print its tables, summary or rendering, or dump tokens."""

from __future__ import annotations

import argparse
import os
import sys

from graphloom import __version__, logs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Property graphs of source code on Spark.")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command")
    for name, text in (("parse-file", "tables of one file"), ("parse-directory", "tables and cross-file summary of a folder"), ("render-graph", "listing or flowchart of a folder"), ("dump-tokens", "tokens of one file")):
        s = sub.add_parser(name, help=text)
        s.add_argument("path")
        s.add_argument("-v", action="count", default=0, dest="verbose")
        if name in ("parse-directory", "render-graph"):
            s.add_argument("--exclude", default="", help="names or paths, separated by commas")
        if name == "render-graph":
            s.add_argument("--format", choices=("ctg", "mermaid"), default="ctg")
            s.add_argument("--name")
            s.add_argument("--scope")
            s.add_argument("--timestamp")
            s.add_argument("--test-nodes", action="store_true")
            s.add_argument("--external-nodes", action="store_true")
    return p


def listing(g) -> str:
    """Counts by kind and type, then every node and edge."""
    from pyspark.sql import functions as F

    from graphloom.functions.text import flags_text
    from graphloom.operators.graph import counts_by
    from graphloom.schemas import EDGE_TYPES, KINDS, ordinal

    out = ["Nodes by kind:"]
    out += [f"  {r['kind']}: {r['n']}" for r in counts_by(g.nodes, "kind").orderBy(ordinal("kind", KINDS)).collect()]
    out += ["Edges by type:"]
    out += [f"  {r['edge_type']}: {r['n']}" for r in counts_by(g.edges, "edge_type").orderBy(ordinal("edge_type", EDGE_TYPES)).collect()]
    names = g.nodes.select("id", "name")
    nodes = g.nodes.join(names.select(F.col("id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").withColumn("flags", flags_text("lang_meta"))
    for r in nodes.orderBy("id").toLocalIterator():
        sig = f"  {r['signature'][:60]}" if r["signature"] else ""
        out.append(f"[{r['id']}] {r['kind']} {r['name']}" + (f" in {r['parent']}" if r["parent"] else "") + (f" {r['line_start']}-{r['line_end']}" if r["line_start"] is not None else "") + f" {r['visibility']}{r['flags']}{sig}")
    e = g.edges.join(names.select(F.col("id").alias("source_id"), F.col("name").alias("s")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("name").alias("t")), "target_id")
    out += [f"{r['s']} -{r['edge_type']}-> {r['t']} ({r['source']})" for r in e.orderBy("edge_id").toLocalIterator()]
    return "\n".join(out)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 0
    level = logs.by_verbosity(args.verbose)
    log = logs.logger("cli", level, logs.stderr(level))
    if args.command == "dump-tokens":
        from graphloom.sources.zig import tokens

        with open(args.path, encoding="utf-8", errors="replace") as f:
            for t in tokens(f.read()):
                print(f"{t.line}:{t.at}-{t.end} {t.kind} {t.text[:60]!r}")
        return 0
    from pyspark.sql import SparkSession

    from graphloom.plans.index import index_directory, index_source

    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if args.command == "parse-file":
        with open(args.path, encoding="utf-8", errors="replace") as f:
            print(listing(index_source(spark, f.read(), os.path.basename(args.path))))
        return 0
    exclude = tuple(x for x in args.exclude.split(",") if x)
    g, result = index_directory(spark, os.path.abspath(args.path), exclude)
    logs.log(log, "info", "indexed", files=result.files_indexed, errors=result.files_errored)
    if args.command == "parse-directory":
        from graphloom.operators.graph import cross_summary, cross_summary_text, owning

        print(listing(g))
        for r in cross_summary_text(cross_summary(g.edges, owning(g.nodes), g.nodes)).orderBy("src_file", "tgt_file").collect():
            print(f"{r['src_file']} -> {r['tgt_file']}: {r['edges']}")
        return 0
    from graphloom.render import ids

    name = args.name or os.path.basename(os.path.abspath(args.path))
    options = dict(scope=args.scope, timestamp=args.timestamp, tests=args.test_nodes, externals=args.external_nodes)
    if args.format == "ctg":
        from graphloom.render.ctg import render_ctg as render
    else:
        from graphloom.render.mermaid import render_mermaid as render
    sys.stdout.write(ids.text(render(g, name, **options)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
