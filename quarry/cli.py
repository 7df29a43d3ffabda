"""Commands: init, index, search, status, clean, trace callers | callees | graph.

Exit codes: 0 done, 2 nothing found, 1 an error.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import embedding, graph, resolve
from quarry.operators.lexical import QueryError
from quarry.plans import index, output
from quarry.plans.project import Project, ProjectError
from quarry.plans.search import Fusion, search_type
from quarry.sources.config import PROFILES, ModelRegistry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description="Index source code and text; search it and trace calls.")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-C", "--directory", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("init")
    a.add_argument("-p", "--profile", choices=sorted(PROFILES), default="default")
    a.add_argument("-f", "--force", action="store_true")
    a = sub.add_parser("index")
    a.add_argument("--all", action="store_true")
    a.add_argument("-j", "--jobs", type=int)
    a = sub.add_parser("search")
    a.add_argument("query")
    a.add_argument("-n", "--limit", type=int, default=10)
    a.add_argument("-t", "--type", default="hybrid")
    a.add_argument("--pretty", action="store_true")
    a.add_argument("--compact", action="store_true")
    a.add_argument("--excerpt-lines", type=int)
    a.add_argument("--dedupe", dest="dedupe", action="store_true", default=None)
    a.add_argument("--no-dedupe", dest="dedupe", action="store_false")
    sub.add_parser("status")
    a = sub.add_parser("clean")
    a.add_argument("-y", "--yes", action="store_true")
    trace = sub.add_parser("trace").add_subparsers(dest="trace", required=True)
    for name in ("callers", "callees", "graph"):
        a = trace.add_parser(name)
        a.add_argument("symbol")
        a.add_argument("--file")
        a.add_argument("--pretty", action="store_true")
        a.add_argument("--compact", action="store_true")
        if name == "graph":
            a.add_argument("--depth", type=int, default=graph.DEPTH)
            a.add_argument("--format", choices=("jsonl", "dot"), default="jsonl")
    return p


def session(project: Project | None = None, jobs: int | None = None) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    conf = PROFILES[project.config().profile].conf() if project else {}
    return SparkSession.builder.master(f"local[{jobs or '*'}]").appName("quarry").config(map=conf | {"spark.ui.enabled": "false"}).getOrCreate()


def _search(args, spark: SparkSession, project: Project) -> int:
    config = project.config().search
    lines = args.excerpt_lines if args.excerpt_lines is not None else config.excerpt_lines
    if lines is not None and lines < 1:
        raise ValueError("excerpt lines must be at least 1")
    kind = search_type(args.type)
    model = ModelRegistry().get(project.manifest().model)
    vector = embedding.embed_query(args.query, model) if kind != "lexical" else None
    dedupe = config.dedupe if args.dedupe is None else args.dedupe
    found = index.open_engine(spark, project).search(args.query, kind, vector, args.limit, Fusion(), dedupe, config.dedupe_threshold).persist()
    if args.pretty:
        print(output.results_pretty(found, args.query, kind, lines or 8))
    else:
        shown = output.results_compact(found) if args.compact else output.results_jsonl(found, lines)
        for r in shown.collect():
            print(r["line"])
    return 0 if found.count() else 2


def _trace(args, spark: SparkSession, project: Project) -> int:
    t = lambda name: project.table(spark, name)
    files, chunks, calls, imports = t("files"), t("chunks"), t("calls"), t("imports")
    path = None
    if args.file:
        at = Path(args.directory, args.file).resolve()
        path = at.relative_to(project.root).as_posix() if at.is_relative_to(project.root) else args.file
    if args.trace == "callers":
        found = resolve.callers_in_file(args.symbol, path, calls, files, chunks) if path else resolve.callers(args.symbol, calls, files, chunks)
        rows = output.callers_jsonl(found, args.compact).orderBy("caller_file", "call_line", "call_column").collect()
        if args.pretty:
            for r in found.collect():
                print(f"{r['caller_file']}:{r['call_line']}:{r['call_column']} {r['caller_symbol'] or '-'} -> {'.'.join(filter(None, (r['receiver'], r['callee_name'])))}")
        else:
            for r in rows:
                print(r["line"])
        return 0 if rows else 2
    root = resolve.root_chunk(args.symbol, files, chunks, path)
    classified = resolve.classify(calls, files, chunks, imports)
    if args.trace == "callees":
        mine = resolve.callees(classified.where(F.col("caller_chunk_id") == root), files, chunks)
        head = chunks.where(F.col("chunk_id") == root).join(files.select("file_id", F.col("path").alias("file")), "file_id").select("symbol", "file", F.col("start_line").alias("line"))
        if args.pretty:
            for r in mine.orderBy("line", "column").collect():
                place = f"{r['resolved_file']}:{r['resolved_line']}" if r["resolved_file"] else r["target_kind"]
                print(f"{'.'.join(filter(None, (r['receiver'], r['callee_name'])))} ({place})")
        else:
            for r in output.callees_jsonl(head, mine, args.compact).orderBy("ord").collect():
                print(r["line"])
        return 0
    if args.format == "dot" and (args.pretty or args.compact):
        raise ValueError("dot output is neither pretty nor compact")
    nodes, edges = graph.build(classified, spark.createDataFrame([(root,)], "chunk_id long"), files, chunks, args.depth)
    nodes, edges = nodes.persist(), edges.persist()
    if args.format == "dot":
        print(output.dot(nodes, edges))
    elif args.pretty:
        print(output.graph_pretty(nodes, edges))
    else:
        shown = output.graph_compact(nodes, edges).orderBy("ord") if args.compact else output.graph_jsonl(nodes, edges).orderBy("part", "a", "b")
        for r in shown.collect():
            print(r["line"])
    return 0


def run(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "init":
            project = Project.init(args.directory, args.profile, args.force)
            print(f"initialised {project.dir}")
            return 0
        project = Project.find(args.directory)
        if args.command == "clean":
            if not args.yes and input("delete the index? [y/N] ").strip().lower() != "y":
                return 1
            project.clean()
            return 0
        spark = session(project, getattr(args, "jobs", None))
        if args.command == "index":
            done = index.index(spark, project, args.all)
            if not args.quiet:
                print(", ".join(f"{k} {v}" for k, v in done.items()))
            return 0
        if args.command == "status":
            r = project.status(spark).first()
            print("\n".join(f"{k}: {r[k]}" for k in r.asDict()))
            return 0
        return _search(args, spark, project) if args.command == "search" else _trace(args, spark, project)
    except (ProjectError, QueryError, LookupError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run())
