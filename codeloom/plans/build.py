"""Building the graph: nodes, edges and repositories as tables, and a store of them."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import stub_category, stub_name, stub_type
from ..operators.merge import delete_by_prefix, drop_dangling, last_wins, upsert
from ..operators.resolve import address_map, module_map, resolve_targets
from ..operators.semantic import get_resolver
from ..schemas import EDGES, NODES, RELATIONSHIPS, REPOSITORIES, SYMBOLS
from ..sources.parse.dispatch import file_symbols, parse, relationships_of, symbols_of


@dataclass
class Graph:
    """The merged graph; and, where it was indexed from files, the symbols and relationships as parsed, with which it can be repaired."""

    nodes: DataFrame
    edges: DataFrame
    repositories: DataFrame
    symbols: DataFrame | None = None
    references: DataFrame | None = None


def _fit(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, missing ones null."""
    schema = df.sparkSession.createDataFrame([], ddl).schema
    for f in schema:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])


def endpoint_stubs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes for ends of edges that no symbol has: category, type and name from the id's prefix."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    missing = ends.join(nodes.select("id"), "id", "left_anti")
    i = F.col("id")
    return missing.select(i, stub_category(i).alias("category"), stub_type(i).alias("type"), stub_name(i).alias("name"), F.array(F.lit("Symbol")).alias("labels"))


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    """Symbols merged by id; of one id in several repositories at one place that of the last repository."""
    merged = last_wins(symbols.withColumn("_at", F.struct("ord", "repo", "branch")), ["id"], "_at").drop("_at")
    labels = F.when(F.col("type") == "file", F.array(F.lit("Symbol"), F.lit("File"))).otherwise(F.array(F.lit("Symbol")))
    return _fit(merged.withColumn("labels", labels).withColumn("category", F.lit("symbol")), NODES)


def contains_edges(symbols: DataFrame) -> DataFrame:
    """Each file contains the symbols that name it as their file, each repository its files."""
    contains = symbols.where("id <> file_id").select(F.col("file_id").alias("source_id"), F.col("id").alias("target_id"))
    files = symbols.where("type = 'file'").select(F.concat(F.lit("repo:"), F.concat_ws(":", "repo", "branch")).alias("source_id"), F.col("id").alias("target_id"))
    return _fit(contains.union(files).distinct().withColumn("rel_type", F.lit("CONTAINS")), EDGES)


def reference_edges(resolved: DataFrame) -> DataFrame:
    """Resolved relationships merged by (source, type, target)."""
    return _fit(last_wins(resolved, ["source_id", "rel_type", "target_id"], "ord").drop("ord"), EDGES)


def build(symbols: DataFrame, relationships: DataFrame, repositories: DataFrame) -> Graph:
    """Merge symbols by id and relationships, which are resolved ones, and add containment and stubs."""
    nodes = symbol_nodes(symbols)
    edges = reference_edges(relationships).union(contains_edges(symbols))
    stubs = endpoint_stubs(edges.where("not source_id like 'repo:%'"), nodes)
    return Graph(nodes.unionByName(_fit(stubs, NODES)), edges, _fit(repositories, REPOSITORIES))


def index_files(files: DataFrame, semantic: str | None = None, strict: bool = False) -> tuple[Graph, DataFrame]:
    """Parse, resolve and build the graph of a files table; also the rows of files that did not parse."""
    parsed = parse(files, strict).persist()
    symbols = file_symbols(files).unionByName(symbols_of(parsed))
    references = relationships_of(parsed)
    resolved = resolve_targets(references, module_map(symbols), address_map(symbols))
    if semantic:
        backend = get_resolver(semantic)
        if backend is None:
            raise ValueError(f"unknown semantic backend {semantic}")
        resolved = backend.resolve(resolved, symbols)
    repos = files.groupBy(F.col("repo").alias("name"), "branch").agg(F.max("commit").alias("commit"), F.max("root_path").alias("root_path"))
    errors = parsed.where("error is not null").select("path", "error")
    built = build(symbols, resolved, repos.withColumn("indexed_at", F.current_timestamp()))
    return replace(built, symbols=symbols, references=references), errors


def merge_graphs(old: Graph, new: Graph) -> Graph:
    """The old graph with the new one's nodes, edges and repositories put over it; stubs never replace symbols."""
    real, stubs = new.nodes.where("category = 'symbol'"), new.nodes.where("category <> 'symbol'")
    nodes = upsert(old.nodes, real, ["id"])
    nodes = nodes.unionByName(stubs.join(nodes.select("id"), "id", "left_anti").select(*nodes.columns))
    parsed = [None, None]
    if old.symbols is not None and new.symbols is not None:
        ids = new.symbols.where("type = 'file'").select(F.col("id").alias("file_id")).distinct()
        parsed = [a.join(ids, file == ids.file_id, "left_anti").unionByName(b) for a, b, file in ((old.symbols, new.symbols, old.symbols.file_id), (old.references, new.references, file_of_reference()))]
    return Graph(nodes, upsert(old.edges, new.edges, ["source_id", "rel_type", "target_id"]), upsert(old.repositories, new.repositories, ["name", "branch"]), *parsed)


def file_of_reference():
    """The id of the file that a parsed relationship stands in."""
    return F.concat_ws(":", "repo", "branch", F.col("ord.path"))


def clear_repository(graph: Graph, repo: str, keep_shared: bool = True) -> Graph:
    """Without a repository's symbols, their edges and its row.

    Placeholders that several repositories share carry the last one's name; with
    ``keep_shared`` they stay if an edge of another repository ends there.
    """
    mine = graph.nodes.where(F.col("repo") == repo)
    if keep_shared:
        others = graph.edges.where(F.col("repo") != repo).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        mine = mine.join(others, "id", "left_anti")
    gone = mine.select("id")
    files = graph.edges.where(F.col("source_id").startswith(f"repo:{repo}:")).select(F.col("source_id").alias("id")).distinct()
    return Graph(graph.nodes.join(gone, "id", "left_anti"), drop_dangling(graph.edges, gone.union(files)), graph.repositories.where(F.col("name") != repo), *[x if x is None else x.where(F.col("repo") != repo) for x in (graph.symbols, graph.references)])


def remove_file_symbols(graph: Graph, file_id: str, keep_incoming: bool = False) -> Graph:
    """Without the symbols below a file, and their edges; with ``keep_incoming`` other files' edges to them stay."""
    below = graph.nodes.where(F.col("id").startswith(file_id + ":")).select("id")
    nodes = delete_by_prefix(graph.nodes, "id", file_id + ":")
    if keep_incoming:
        inside = graph.edges.where(F.col("source_id").startswith(file_id + ":") | (F.col("source_id") == file_id) & F.col("target_id").startswith(file_id + ":"))
        edges = graph.edges.join(inside.select("source_id", "rel_type", "target_id"), ["source_id", "rel_type", "target_id"], "left_anti").select(*graph.edges.columns)
    else:
        edges = drop_dangling(graph.edges, below).select(*graph.edges.columns)
    return Graph(nodes, edges, graph.repositories)


def _below(ids: DataFrame, column: str, files: DataFrame) -> DataFrame:
    """The rows of ``ids`` whose id in ``column`` lies below one of the files (file_id): begins with a file's id and a colon.

    Each beginning of an id that ends at a colon is looked up, so it is a plain join, of as many rows as ids have parts.
    """
    parts = F.split(column, ":")
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ":"))
    kept = F.filter(beginnings, lambda b: b != F.col(column))
    rows = ids.select(F.col(column), F.explode(kept).alias("file_id"))
    return rows.join(files.select("file_id").distinct(), "file_id", "left_semi").select(column).distinct()


def remove_files(graph: Graph, files: DataFrame, keep_incoming: bool = False) -> Graph:
    """Without the symbols below any of the files (file_id), and their edges, in one plan; the files' own nodes stay.

    With ``keep_incoming`` only edges that start below a file go, and a file's own to what is below it; edges of others to there stay.
    """
    below = _below(graph.nodes, "id", files)
    nodes = graph.nodes.join(below, "id", "left_anti").select(*graph.nodes.columns)
    if not keep_incoming:
        return Graph(nodes, drop_dangling(graph.edges, below).select(*graph.edges.columns), graph.repositories)
    ends = _below(graph.edges, "source_id", files)
    outside = graph.edges.join(ends, "source_id", "left_anti")
    own = files.select(F.col("file_id").alias("source_id")).distinct()
    inside = outside.join(own, "source_id", "left_semi").where(F.col("target_id").startswith(F.concat("source_id", F.lit(":")))).select("source_id", "rel_type", "target_id").distinct()
    edges = outside.join(inside, ["source_id", "rel_type", "target_id"], "left_anti").select(*graph.edges.columns)
    return Graph(nodes, edges, graph.repositories)


class GraphStore:
    """A graph in parquet: each write makes a new version, and a pointer file names the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _pointer(self) -> str:
        return os.path.join(self.path, "CURRENT.json")

    def exists(self) -> bool:
        return os.path.exists(self._pointer())

    def read(self) -> Graph:
        """The current graph; an empty one before the first write."""
        if not self.exists():
            return Graph(*(self.spark.createDataFrame([], x) for x in (NODES, EDGES, REPOSITORIES)))
        with open(self._pointer()) as f:
            current = json.load(f)
        version = current["version"]
        kinds = (("nodes", NODES), ("edges", EDGES), ("repositories", REPOSITORIES), *((("symbols", SYMBOLS), ("references", RELATIONSHIPS)) if current.get("parsed") else ()))
        return Graph(*(_fit(self.spark.read.parquet(f"{self.path}/{version}/{name}"), ddl) for name, ddl in kinds))

    def write(self, graph: Graph) -> None:
        """Write a version, then point to it; readers see the old one or the new one, never a part.

        Edges lie in folders by type, so that a query of one type reads no other.
        """
        version = uuid.uuid4().hex
        graph.nodes.write.parquet(f"{self.path}/{version}/nodes")
        graph.edges.write.partitionBy("rel_type").parquet(f"{self.path}/{version}/edges")
        graph.repositories.write.parquet(f"{self.path}/{version}/repositories")
        parsed = graph.symbols is not None
        if parsed:
            graph.symbols.write.parquet(f"{self.path}/{version}/symbols")
            graph.references.write.parquet(f"{self.path}/{version}/references")
        os.makedirs(self.path, exist_ok=True)
        with open(self._pointer() + ".new", "w") as f:
            json.dump({"version": version, "parsed": parsed}, f)
        os.replace(self._pointer() + ".new", self._pointer())
