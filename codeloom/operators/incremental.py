"""Incremental indexing by content hash."""

from __future__ import annotations

import hashlib
import os
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import IGNORED_DIRS
from ..operators.merge import upsert
from ..operators.repair import repair
from ..operators.resolve import address_map, module_map, resolve_targets
from ..plans.build import Graph, GraphStore, build, merge_graphs
from ..schemas import file_id
from ..sources.parse.dispatch import file_symbols, parse, relationships_of, symbols_of
from ..sources.shared import written
from ..sources.scan import MAX_FILE_BYTES, language_of_name


def classify(files: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Add ``status``: created if the file is not stored, up_to_date if its hash is the same, else refreshed.

    ``files`` and ``stored`` have (file_id, content_hash); a stored file without a hash is refreshed.
    """
    old = stored.select("file_id", F.col("content_hash").alias("_old"), F.lit(True).alias("_there"))
    met = files.join(old, "file_id", "left")
    same = F.coalesce(F.col("_old") == F.col("content_hash"), F.lit(False)) & F.lit(not force)
    return met.withColumn("status", F.when(F.col("_there").isNull(), "created").when(same, "up_to_date").otherwise("refreshed")).drop("_old", "_there")


def stored_hashes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.array_contains("labels", "File")).select(F.col("id").alias("file_id"), F.get_json_object("metadata", "$.content_hash").alias("content_hash"))


def stored_modules(nodes: DataFrame) -> DataFrame:
    """What stored nodes a module name may stand for, so that a file indexed alone finds other files' definitions."""
    return module_map(nodes)


def refresh(graph: Graph, files: DataFrame, force: bool = False, removed: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """Index the files that changed and put them over the graph; also each file's status.

    A graph that holds what was parsed is repaired: it becomes what a full build of all files now makes, also where
    relationships of other files name what came, went or moved; ``removed`` (file_id) are files that are there no more. In a graph
    without it symbols that a changed file no longer has go, with their own edges, and edges of other
    files that end there stay as they are.
    """
    ids = F.concat_ws(":", "repo", "branch", "path")
    status = classify(files.withColumn("file_id", ids).select("file_id", "content_hash"), stored_hashes(graph.nodes), force)
    changed = files.withColumn("file_id", ids).join(status.where("status <> 'up_to_date'").select("file_id"), "file_id", "left_semi").drop("file_id")
    if graph.symbols is not None:
        status = written(status, "status")
        parsed = written(parse(changed), "parsed")
        gone = status.where("status <> 'up_to_date'").select("file_id")
        gone = gone if removed is None else gone.union(removed.select("file_id"))
        repaired = repair(graph, gone, file_symbols(changed).unionByName(symbols_of(parsed)), relationships_of(parsed))
        return _with_repositories(repaired, changed), status
    if removed is not None:
        raise ValueError("files can be removed only from a graph that holds what was parsed; see remove_files")
    parsed = written(parse(changed), "parsed")
    symbols = file_symbols(changed).unionByName(symbols_of(parsed))
    addresses, own = address_map(graph.nodes), address_map(symbols)
    known = stored_modules(graph.nodes.unionByName(symbols, allowMissingColumns=True))
    resolved = resolve_targets(relationships_of(parsed), known, own.union(addresses.join(own, "key", "left_anti").select("key", "id")))
    repos = changed.groupBy(F.col("repo").alias("name"), "branch").agg(F.max("commit").alias("commit"), F.max("root_path").alias("root_path")).withColumn("indexed_at", F.current_timestamp())
    gone = status.where("status = 'refreshed'").select(F.col("file_id").alias("_file"))
    mine = graph.nodes.where("id <> concat_ws(':', repo, branch, file_path)").join(gone, F.concat_ws(":", "repo", "branch", "file_path") == F.col("_file"), "left_semi").where("category = 'symbol'").select("id")
    sources = mine.union(gone.select(F.col("_file").alias("id")))
    edges = graph.edges.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(*graph.edges.columns)
    kept = Graph(graph.nodes.join(mine, "id", "left_anti").select(*graph.nodes.columns), edges, graph.repositories)
    return merge_graphs(kept, build(symbols, resolved, repos)), status


def _with_repositories(graph: Graph, changed: DataFrame) -> Graph:
    """The repositories of changed files get their commit and the time of indexing."""
    new = changed.groupBy(F.col("repo").alias("name"), "branch").agg(F.max("commit").alias("commit"), F.max("root_path").alias("root_path")).withColumn("indexed_at", F.current_timestamp())
    return replace(graph, repositories=upsert(graph.repositories, new, ["name", "branch"]))


def _error(code: str, path: str) -> dict:
    return {"status": "error", "error": code, "file_path": path}


def index_file(store: GraphStore, path: str, repo: str | None = None, force: bool = False, ignored: tuple[str, ...] = IGNORED_DIRS) -> dict:
    """Index one file if its content changed; returns its status or an error code.

    Codes: REPOSITORY_REQUIRED, REPOSITORY_UNKNOWN, FILE_OUTSIDE_REPOSITORY,
    FILE_DOES_NOT_EXIST, FILE_IGNORED, FILE_UNREADABLE, FILE_TOO_LARGE,
    UNSUPPORTED_FILE_TYPE, INDEXING_FAILED.
    """
    graph = store.read()
    repos = [r.asDict() for r in graph.repositories.orderBy(F.desc("indexed_at")).collect()]
    if repo:
        matching = [r for r in repos if repo.lower() in (r["name"].lower(), os.path.basename(r["root_path"].rstrip("/")).lower())]
        if not matching:
            return _error("REPOSITORY_UNKNOWN", path)
    elif not os.path.isabs(path):
        return _error("REPOSITORY_REQUIRED", path)
    else:
        matching = repos
    chosen = None
    for r in matching:
        root = os.path.realpath(r["root_path"])
        full = os.path.realpath(path if os.path.isabs(path) else os.path.join(root, path))
        if full != root and os.path.commonpath([root, full]) == root:
            chosen = (r, full, os.path.relpath(full, root).replace(os.sep, "/"))
            break
    if chosen is None:
        return _error("FILE_OUTSIDE_REPOSITORY" if repo else "REPOSITORY_UNKNOWN", path)
    r, full, relative = chosen
    if not os.path.isfile(full):
        return _error("FILE_DOES_NOT_EXIST", path)
    if set(relative.split("/")) & set(ignored):
        return _error("FILE_IGNORED", path)
    try:
        with open(full, "rb") as f:
            content = f.read()
    except OSError:
        return _error("FILE_UNREADABLE", path)
    if len(content) > MAX_FILE_BYTES:
        return _error("FILE_TOO_LARGE", path)
    language = language_of_name(relative)
    if not language:
        return _error("UNSUPPORTED_FILE_TYPE", path)
    digest = hashlib.sha256(content).hexdigest()
    one = store.spark.createDataFrame([(r["name"], r["branch"], r["commit"], r["root_path"], relative, language, len(content), content, digest)], "repo string, branch string, commit string, root_path string, path string, language string, size bigint, content binary, content_hash string")
    try:
        new, status = refresh(graph, one, force)
        found = status.first()["status"]
        if found != "up_to_date":
            store.write(new)
    except Exception as e:
        return _error("INDEXING_FAILED", path) | {"detail": str(e)[:300]}
    return {"status": found, "file_id": file_id(r["name"], r["branch"], relative), "repo": r["name"], "content_hash": digest}

