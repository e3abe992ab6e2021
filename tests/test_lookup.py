import re

import pytest

from codeloom.operators import queries
from codeloom.plans import driver_queries
from codeloom.plans.build import Graph
from codeloom.plans.lookup import open_lookup, write_lookup
from codeloom.schemas import REPOSITORIES


@pytest.fixture(scope="module")
def graph(spark, sf_dir):
    edges, nodes = driver_queries._import_graph(spark, sf_dir)
    more, types = driver_queries.type_graph(spark, sf_dir)
    edges = edges.union(driver_queries.supply_edges(spark, sf_dir)).union(more)
    inherits = driver_queries._edges(spark.range(5), driver_queries._id("customer", "id"), driver_queries._id("customer", "id"), "INHERITS")
    return Graph(nodes.union(types), edges.union(inherits), spark.createDataFrame([], REPOSITORIES))


@pytest.fixture(scope="module")
def lookup(graph, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('lookup')}/graph"
    write_lookup(graph, path, 8)
    return open_lookup(graph.nodes.sparkSession, path, 8)


def one_bucket(spark, make, capsys):
    """Whether a scan of the plan reads one bucket; plans name buckets only where they are kept apart."""
    automatic = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(automatic, "false")
    try:
        capsys.readouterr()
        make().explain("formatted")
        return "SelectedBucketsCount: 1 out of 8" in capsys.readouterr().out
    finally:
        spark.conf.set(automatic, "true")


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_tables_are_whole(graph, lookup):
    assert rows(lookup.nodes) == rows(graph.nodes)
    assert rows(lookup.edges_by_source) == rows(lookup.edges_by_target) == rows(graph.edges)


CASES = {
    "callers": (queries.get_callers, "part:1"),
    "callees": (queries.get_callees, "customer:1"),
    "imports": (queries.get_imports, "nation:3"),
    "importers": (queries.get_importers, "module:1"),
    "inherits": (queries.get_inherits, "customer:2"),
    "functions_of_composition": (queries.get_functions_for_composition, "composition:1"),
}


@pytest.mark.parametrize("name", CASES)
def test_same_rows_from_one_bucket(spark, graph, lookup, name, capsys):
    plain, id_ = CASES[name]
    found = getattr(lookup, name)(id_)
    assert found.count() and rows(found) == rows(plain(graph.edges, graph.nodes, id_))
    assert one_bucket(spark, lambda: getattr(lookup, name)(id_), capsys)


def test_one_node(spark, lookup, capsys):
    found = lookup.find("customer:7")
    assert [r.id for r in found.collect()] == ["customer:7"] and lookup.find("nobody").isEmpty()
    assert one_bucket(spark, lambda: lookup.find("customer:7"), capsys)


def test_a_table_of_ids_moves_and_the_edges_stay(spark, graph, lookup):
    ids = spark.range(100).selectExpr("concat('customer:', id) AS id")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        chosen = lookup.edges_by_source.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        plan = chosen._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1, "of the ids only"
    assert rows(lookup.callees(ids)) == rows(queries.get_callees(graph.edges, graph.nodes, ids))


def test_summaries_of_files_gather_no_callers(spark, sf_dir):
    """The same as the nested explanation says, while no plan collects the callers of a file."""
    from pyspark.sql import functions as F

    from codeloom.operators import queries
    from codeloom.plans import driver_queries

    nodes, edges = driver_queries.supply_nodes(spark, sf_dir), driver_queries.supply_edges(spark, sf_dir)
    files = nodes.where("type = 'file'")
    nested = {r.id: r for r in queries.explain_files(edges, nodes, files).collect()}
    short = queries.summarize_files(edges, nodes, files)
    assert "confidence" not in "".join(line for line in short._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in line)
    for r in short.collect():
        n = nested[r.id]
        assert r.symbols == ",".join(sorted(s.name for s in n.symbols)) and r.callees == ",".join(c.id for c in n.callees)
        assert (r.callers, r.different_callers) == (len(n.callers), len({c.id for c in n.callers}))
    runs = spark.range(10000).select((F.col("id") % 2).alias("k"), F.lpad(F.col("id").cast("string"), 5, "0").alias("v"))
    got = {r.k: r.v for r in queries.joined_in_order(runs, "k", "v").collect()}
    assert got == {k: ",".join(f"{i:05}" for i in range(k, 10000, 2)) for k in (0, 1)}


def test_edges_are_made_once_and_by_as_many_tasks_as_a_shuffle_has(spark, tmp_path):
    from pyspark.sql import functions as F

    from codeloom.plans.build import _fit
    from codeloom.schemas import EDGES, NODES

    made = spark.sparkContext.accumulator(0)

    def kind(number):
        made.add(1)
        return "CALLS"

    edges = spark.range(100).select(F.col("id").cast("string").alias("source_id"), F.lit("t").alias("target_id"), F.udf(kind, "string")("id").alias("rel_type"))
    nodes = spark.range(100).select(F.col("id").cast("string").alias("id"))
    graph = Graph(_fit(nodes, NODES), _fit(edges, EDGES), spark.createDataFrame([], REPOSITORIES))
    held = write_lookup(graph, str(tmp_path / "lookup"), 2)
    assert made.value == 100
    assert held.callers("t").count() == 100 and held.callees("7").count() == 0
    assert len(list((tmp_path / "lookup" / "edges_by_source").glob("*.parquet"))) == 4  # the session's shuffles have 4 tasks
