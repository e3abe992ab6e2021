"""Repairing a graph after some files changed: only what the change reaches is made again, and it is what a full build makes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.build import Graph, _fit, contains_edges, endpoint_stubs, file_of_reference, reference_edges, symbol_nodes
from ..schemas import EDGES, NODES
from ..sources.shared import written
from .resolve import address_keys, module_keys, owners, resolve_targets, symbolic_key

UNIT = ["source_id", "rel_type"]


def _keys(symbols: DataFrame) -> DataFrame:
    """(map, key, id, ord) of what symbols can be named by."""
    return module_keys(symbols).select(F.lit("module").alias("map"), "key", "id", "ord").union(address_keys(symbols).select(F.lit("tfaddr"), "key", "id", "ord"))


def _owners(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(map, key, id): who owns each of the wanted (map, key)."""
    rows = _keys(symbols).join(wanted, ["map", "key"], "left_semi")
    return owners(rows.select(F.struct("map", "key").alias("key"), "id", "ord")).select("key.map", "key.key", "id")


def changed_keys(before: DataFrame, after: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(map, key) that appeared, went, or have another owner: of all symbols before and after, when ``old`` ones were replaced by ``new`` ones."""
    touched = written(_keys(old).select("map", "key").union(_keys(new).select("map", "key")).distinct(), "touched-keys")
    was, is_ = _owners(before, touched).withColumnRenamed("id", "was"), _owners(after, touched).withColumnRenamed("id", "is")
    return was.join(is_, ["map", "key"], "full").where("not (was <=> is)").select("map", "key")


def repair(graph: Graph, gone: DataFrame, symbols: DataFrame, references: DataFrame) -> Graph:
    """The graph after the files ``gone`` (file_id), changed or removed ones, were replaced by what was parsed of them anew.

    A source's relationships of one type are made again where its file changed, or where one of them names a key
    whose owner changed; nodes where a symbol of the id came or went; stubs where an edge came or went. All else is
    taken over. ``symbols`` and ``references`` hold the changed files' rows only. The result has the rows of a
    full build of all symbols and references. Without files gone and without rows nothing changes.
    """
    gone = written(gone.select("file_id").distinct(), "changed-files")
    symbols, references = written(symbols, "new-symbols"), written(references, "new-references")
    old_symbols = graph.symbols.join(gone, "file_id", "left_semi").select(*symbols.columns)
    in_gone = file_of_reference() == F.col("file_id")
    old_references = graph.references.join(gone, in_gone, "left_semi")
    every = graph.symbols.join(gone, "file_id", "left_anti").select(*symbols.columns).unionByName(symbols)
    all_references = graph.references.join(gone, in_gone, "left_anti").unionByName(references)

    # relationships
    keys = written(changed_keys(graph.symbols, every, old_symbols, symbols), "changed-keys")
    which, key = symbolic_key(F.col("target_id"))
    naming = all_references.withColumn("map", which).withColumn("key", key).join(keys, ["map", "key"], "left_semi")
    units = written(naming.select(*UNIT).union(old_references.select(*UNIT)).union(references.select(*UNIT)).distinct(), "units")
    again = written(all_references.join(units, UNIT, "left_semi").select(*references.columns), "references-again")
    named = again.select(which.alias("map"), key.alias("key")).where("map is not null").distinct()
    found = written(_owners(every, named), "owners")
    maps = [found.where(F.col("map") == m).select("key", "id") for m in ("module", "tfaddr")]
    held = F.col("rel_type") == "CONTAINS"
    dropped = graph.edges.where(~held).join(units, UNIT, "left_semi").select("source_id", "target_id")
    kept = graph.edges.where(~held).join(units, UNIT, "left_anti").select(*graph.edges.columns)
    made = written(reference_edges(resolve_targets(again, *maps)), "edges-again")

    # containment: a changed file's symbols, and its place in its repository
    files = gone.select(F.col("file_id").alias("source_id"))
    inside = graph.edges.where(held).join(files, "source_id", "left_anti").join(gone.select(F.col("file_id").alias("target_id")), "target_id", "left_anti")
    holding = written(contains_edges(symbols), "contained-again")
    edges = kept.union(inside.select(*graph.edges.columns)).union(made).union(holding)

    # nodes, then stubs for the ends of edges that came or lost an edge or a symbol
    ids = written(old_symbols.select("id").union(symbols.select("id")).distinct(), "changed-ids")
    nodes = symbol_nodes(every.join(ids, "id", "left_semi").select(*symbols.columns))
    ends = F.explode(F.array("source_id", "target_id")).alias("id")
    was_inside = graph.edges.where(held).join(files, "source_id", "left_semi").select("source_id", "target_id")
    moved = [dropped, was_inside, made.select("source_id", "target_id"), holding.select("source_id", "target_id")]
    touched = ids
    for pairs in moved:
        touched = touched.union(pairs.select(ends))
    touched = written(touched.distinct(), "touched-ids")
    real = graph.nodes.where("category = 'symbol'").join(ids, "id", "left_anti").select(*graph.nodes.columns).unionByName(_fit(nodes, NODES))
    stubs = graph.nodes.where("category <> 'symbol'").join(touched, "id", "left_anti").select(*graph.nodes.columns)
    near = edges.where("not source_id like 'repo:%'").select("source_id", "target_id")
    near = near.join(touched.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("source_id", "source_id").toDF("source_id", "target_id").union(
        near.join(touched.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("target_id", "target_id").toDF("source_id", "target_id")
    )
    stubs = stubs.unionByName(_fit(endpoint_stubs(near.distinct(), real), NODES))
    return replace(graph, nodes=real.unionByName(stubs), edges=_fit(edges, EDGES), symbols=every, references=all_references)
