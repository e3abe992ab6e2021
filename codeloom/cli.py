"""Command line of the engine."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import queries as q
from .operators import traverse
from .operators.semantic import RESOLVERS
from .plans.build import GraphStore, clear_repository, index_files, merge_graphs
from .sources.scan import git_info, scan


def _index(spark: SparkSession, store: GraphStore, a: argparse.Namespace) -> str:
    if a.semantic and a.semantic_backend not in RESOLVERS:
        return f"Unknown semantic backend {a.semantic_backend}; available: {', '.join(RESOLVERS)}"
    info = git_info(a.path)
    old = store.read()
    if a.clear:
        old = clear_repository(old, info["repo_name"])
    files = scan(spark, a.path, info["repo_name"], info["branch"], info["commit"])
    graph, errors = index_files(files, a.semantic_backend if a.semantic else None)
    for r in errors.collect():
        print(f"{r['path']}: {r['error']}", file=sys.stderr)
    store.write(merge_graphs(old, graph))
    return f"Indexed {info['repo_name']} at {info['commit'][:8]}: {graph.nodes.count()} nodes, {graph.edges.count()} edges"


def _explain(store: GraphStore, a: argparse.Namespace) -> str:
    g = store.read()
    found = q.explain_file(g.edges, g.nodes, g.repositories, a.file_path, a.repo)
    if "error" in found:
        print(found["error"], file=sys.stderr)
        return ""
    if a.format == "json":
        return json.dumps(found, default=str, indent=2)
    counts = ", ".join(f"{n} {k}" for k, n in found["counts"].items())
    lines = [f"{found['file']['file_path']} ({found['file']['repo']}): {counts}"]
    return "\n".join(lines + [f"  {s['type']} {s['name']}" for s in found["symbols"]])


def _shown(df: DataFrame, empty: str) -> str:
    rows = [" | ".join(str(v) for v in r if v is not None) for r in df.collect()]
    return "\n".join(rows) or empty


#: Command: its arguments (a leading -- makes an option), how it asks, and what it says of an empty answer.
COMMANDS = {
    "find-symbol": (("name", "--repo", "--branch"), lambda g, a: q.find_symbol(g.nodes, a.name, a.repo, a.branch), "No symbols found with that name."),
    "get-callers": (("symbol_id",), lambda g, a: q.get_callers(g.edges, g.nodes, a.symbol_id).select("source_id", "name", "confidence"), "No callers found."),
    "get-callees": (("symbol_id",), lambda g, a: q.get_callees(g.edges, g.nodes, a.symbol_id).select("target_id", "name", "confidence"), "No callees found."),
    "get-imports": (("file_id",), lambda g, a: q.get_imports(g.edges, g.nodes, a.file_id).select("target_id", "name"), "No imports found."),
    "get-importers": (("module_id",), lambda g, a: q.get_importers(g.edges, g.nodes, a.module_id).select("source_id", "name"), "No importers found."),
    "trace": (("start_id", "--depth", "--max-paths"), lambda g, a: traverse.trace_execution_flow(g.edges, a.start_id, int(a.depth or 10), int(a.max_paths or 20)).select(traverse.render_path("path")), "No execution paths found."),
    "get-dependencies": (("symbol_id", "--depth"), lambda g, a: traverse.get_dependencies(g.edges, a.symbol_id, int(a.depth or 5)).select("node", "d"), "No dependencies found."),
    "get-dependents": (("symbol_id", "--depth"), lambda g, a: traverse.get_dependents(g.edges, a.symbol_id, int(a.depth or 5)).select("node", "d"), "No dependents found."),
    "find-file": (("path", "--repo", "--branch"), lambda g, a: q.find_file(g.nodes, a.path, a.repo, a.branch, repositories=g.repositories), "No file found."),
    "list-symbols": (("--type", "--repo", "--branch"), lambda g, a: q.list_symbols(g.nodes, a.type, a.repo, a.branch), "No symbols found."),
    "list-resources": (("--repo", "--branch"), lambda g, a: q.list_resources(g.nodes, a.repo, a.branch).select("id", "name", "label"), "No resources found."),
    "list-repos": ((), lambda g, a: q.list_repositories(g.repositories), "No repositories indexed."),
    "find-xrd": (("kind", "--repo"), lambda g, a: q.find_xrd_for_kind(g.edges, g.nodes, a.kind, a.repo).select("id", "name", "repo"), "No XRD found for that kind."),
    "find-compositions": (("kind", "--repo"), lambda g, a: q.find_compositions_for_kind(g.edges, g.nodes, a.kind, a.repo).select("id", "name", "repo"), "No compositions found for that kind."),
    "composition-functions": (("composition_id",), lambda g, a: q.get_functions_for_composition(g.edges, g.nodes, a.composition_id).select("target_id", "name"), "No functions found for that composition."),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codeloom")
    top.add_argument("--store", required=True, help="folder of the graph")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("path")
    index.add_argument("--semantic", action="store_true")
    index.add_argument("--semantic-backend", default="hierarchy")
    index.add_argument("--clear", action="store_true")
    for name, (arguments, _, _) in COMMANDS.items():
        one = commands.add_parser(name)
        for x in arguments:
            one.add_argument(x)
    explain = commands.add_parser("explain")
    explain.add_argument("file_path")
    explain.add_argument("--repo")
    explain.add_argument("--format", choices=("text", "json"), default="text")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("codeloom").getOrCreate()
    store = GraphStore(spark, a.store)
    if a.command == "index":
        out = _index(spark, store, a)
    elif a.command == "explain":
        out = _explain(store, a)
    else:
        _, ask, empty = COMMANDS[a.command]
        out = _shown(ask(store.read(), a), empty)
    print(out)
    return out


if __name__ == "__main__":
    main()
