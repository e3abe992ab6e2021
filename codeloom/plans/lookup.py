"""A graph's tables laid out for look-ups by id: nodes by id, edges by source and, once more, by target.

The tables are bucketed and sorted by their id, with a Bloom filter on it, so a look-up of one id opens one
bucket of many, and joins with a table of ids, however large, move the ids and not the edges. Buckets are
Spark's own; as a path alone does not tell of them, a session registers the tables under names of its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import queries
from ..schemas import EDGES, NODES
from .build import Graph

#: Folder, columns, and the id that the table is bucketed by.
LAYOUT = {"nodes": (NODES, "id"), "edges_by_source": (EDGES, "source_id"), "edges_by_target": (EDGES, "target_id")}


@dataclass
class Lookup:
    """Each table is a DataFrame of all its rows; a filter or join on its id is what it is laid out for."""

    nodes: DataFrame
    edges_by_source: DataFrame
    edges_by_target: DataFrame

    def find(self, id_: str) -> DataFrame:
        """The node of an id."""
        return self.nodes.where(self.nodes["id"] == id_)

    def callers(self, ids: DataFrame | str) -> DataFrame:
        return queries.get_callers(self.edges_by_target, self.nodes, ids)

    def callees(self, ids: DataFrame | str) -> DataFrame:
        return queries.get_callees(self.edges_by_source, self.nodes, ids)

    def imports(self, ids: DataFrame | str) -> DataFrame:
        return queries.get_imports(self.edges_by_source, self.nodes, ids)

    def importers(self, ids: DataFrame | str) -> DataFrame:
        return queries.get_importers(self.edges_by_target, self.nodes, ids)

    def inherits(self, ids: DataFrame | str) -> DataFrame:
        return queries.get_inherits(self.edges_by_source, self.nodes, ids)

    def functions_of_composition(self, ids: DataFrame | str) -> DataFrame:
        return queries.get_functions_for_composition(self.edges_by_source, self.nodes, ids)


def open_lookup(spark: SparkSession, path: str, buckets: int) -> Lookup:
    """The tables that ``write_lookup`` left below ``path``, with as many buckets as it was given."""
    tables = {}
    for folder, (columns, by) in LAYOUT.items():
        name = f"lookup_{folder}_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION '{path}/{folder}'")
        tables[folder] = spark.table(name)
    return Lookup(**tables)


def write_lookup(graph: Graph, path: str, buckets: int = 64) -> Lookup:
    """Write the graph's tables bucketed, and open them. ``path`` is a new folder.

    Rows are dealt out to a multiple of the buckets, at least as many tasks as the session's shuffles have; a task's ids all
    belong to one bucket, which has a file for each of its tasks. The writer sorts them. Edges are made once: those by target are
    read from those by source. An id with a third of all edges fills one file, which readers split as any large file.
    """
    spark = graph.nodes.sparkSession
    tasks = buckets * -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    rows = {"nodes": graph.nodes, "edges_by_source": graph.edges}
    for folder, (columns, by) in LAYOUT.items():
        table = rows[folder] if folder in rows else spark.read.schema(columns).parquet(f"{path}/edges_by_source")
        name = f"lookup_{folder}_{uuid.uuid4().hex}"
        dealt = table.repartition(tasks, by)
        writer = dealt.write.option(f"parquet.bloom.filter.enabled#{by}", "true").bucketBy(buckets, by).sortBy(by)
        writer.option("path", f"{path}/{folder}").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # its files stay, as they lie at a path of their own
    return open_lookup(spark, path, buckets)
