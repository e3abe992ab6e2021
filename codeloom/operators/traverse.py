"""Variable-length paths: all trails by recursive SQL, the first ones level by level, and distinct reachability by frontiers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

DEPENDENCIES = ("CALLS", "IMPORTS", "DEPENDS_ON")


def trails(edges: DataFrame, seeds: DataFrame | str, depth: int, types: Sequence[str] | None = None, reverse: bool = False) -> DataFrame:
    """(seed, node, d, path) of every trail of 1 to ``depth`` edges: no edge twice, nodes may repeat; a row per trail.

    An edge is its type and both ends, so parallel edges of two types are two edges. The
    frontier is joined with the edges by node at each level, so a level is a shuffle at most.
    """
    spark = edges.sparkSession
    if isinstance(seeds, str):
        seeds = spark.createDataFrame([(seeds,)], "id string")
    chosen = edges.where(F.col("rel_type").isin(*types)) if types else edges
    ends = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    e = chosen.select(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst"), F.concat_ws(">", "rel_type", "source_id", "target_id").alias("edge")).distinct()
    name = f"_{uuid.uuid4().hex[:8]}"
    e.createOrReplaceTempView(f"edges{name}")
    seeds.select(F.col(seeds.columns[0]).alias("id")).distinct().createOrReplaceTempView(f"seeds{name}")
    return spark.sql(f"""
        WITH RECURSIVE walk(seed, node, path, used, d) MAX RECURSION LEVEL {int(depth) + 1} AS (
          SELECT id, id, array(id), CAST(array() AS ARRAY<STRING>), 0 FROM seeds{name}
          UNION ALL
          SELECT w.seed, e.dst, array_append(w.path, e.dst), array_append(w.used, e.edge), w.d + 1
          FROM walk w JOIN edges{name} e ON e.src = w.node
          WHERE w.d < {int(depth)} AND NOT array_contains(w.used, e.edge))
        SELECT seed, node, d, path FROM walk WHERE d > 0""")


def first_trails(edges: DataFrame, seed: str, depth: int, limit: int, types: Sequence[str] | None = None, reverse: bool = False, made: list[int] | None = None) -> DataFrame:
    """The first ``limit`` rows of ``trails`` from one seed by depth, then by path, without making the rest.

    Trails are made level by level. A level that fills the limit is cut to what is wanted and is the
    last; one that does not is smaller than the limit, so what is extended is always fewer rows than the
    limit, and such a table is sent to the edges, which are not moved. Levels are written to the shared
    folder. The number of rows that each level kept is appended to ``made``.
    """
    spark = edges.sparkSession
    chosen = edges.where(F.col("rel_type").isin(*types)) if types else edges
    ends = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    e = chosen.select(F.col(ends[0]).alias("node"), F.col(ends[1]).alias("next"), F.concat_ws(">", "rel_type", "source_id", "target_id").alias("edge"))
    level = spark.createDataFrame([(seed, [seed], [])], "node string, path array<string>, used array<string>")
    levels, room = [], limit
    for d in range(1, depth + 1):
        onward = e.join(F.broadcast(level), "node").where(~F.array_contains("used", F.col("edge")))
        onward = onward.select(F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"), F.array_append("used", F.col("edge")).alias("used")).distinct()
        level = written(onward.orderBy("path", "used").limit(room), "trails")
        n = level.count()
        if made is not None:
            made.append(n)
        if not n:
            break
        levels.append(level.select(F.lit(seed).alias("seed"), "node", F.lit(d).alias("d"), "path"))
        room -= n
        if not room:
            break
    none = spark.createDataFrame([], "seed string, node string, d int, path array<string>")
    return reduce(DataFrame.union, levels, none)


def _found(edges: DataFrame, seed: str, depth: int, limit: int | None, types: Sequence[str], reverse: bool = False) -> DataFrame:
    return trails(edges, seed, depth, types, reverse) if limit is None else first_trails(edges, seed, depth, limit, types, reverse)


def get_dependencies(edges: DataFrame, seed: str, depth: int = 5, limit: int | None = 100) -> DataFrame:
    """End nodes of dependency trails, one row per trail; the limit takes the shortest, then the first by path."""
    return _found(edges, seed, depth, limit, DEPENDENCIES)


def get_dependents(edges: DataFrame, seed: str, depth: int = 5, limit: int | None = 100) -> DataFrame:
    """The same against the direction of the edges."""
    return _found(edges, seed, depth, limit, DEPENDENCIES, reverse=True)


def trace_execution_flow(edges: DataFrame, seed: str, depth: int = 10, max_paths: int | None = 20) -> DataFrame:
    """Call paths from a symbol, of every length, shortest first."""
    return _found(edges, seed, depth, max_paths, ("CALLS",))


def render_path(path) -> F.Column:
    return F.array_join(path, " -> ")


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """(id, d): every node reachable from the seeds, once, with its least distance; seeds have 0.

    Each level joins only the nodes found last. The edges, like the nodes of each level, are written
    to the shared folder once and read from there; repeated edges stay, as each level's nodes are made distinct.
    """
    chosen = edges.where(F.col("rel_type").isin(*types)) if types else edges
    e = written(chosen.select("source_id", "target_id"), "edges")
    frontier = written(seeds.select(F.col(seeds.columns[0]).alias("id"), F.lit(0).alias("d")).distinct(), "reached")
    seen, level = frontier, 0
    while depth is None or level < depth:
        level += 1
        step = e.join(frontier.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
        frontier = written(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("d")), "reached")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen
