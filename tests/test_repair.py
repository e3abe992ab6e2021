import hashlib
import random

import pytest

from codeloom.operators.incremental import refresh
from codeloom.operators.repair import repair
from codeloom.plans.build import GraphStore, index_files, remove_file_symbols, remove_files
from codeloom.schemas import FILES
from pyspark.sql import functions as F

LANGUAGE = {"py": "python", "tf": "hcl"}


def table(spark, sources):
    rows = [("r", "main", "c", "/r", path, LANGUAGE[path.rsplit(".", 1)[1]], len(text), text.encode(), hashlib.sha256(text.encode()).hexdigest()) for path, text in sources.items()]
    return spark.createDataFrame(rows, FILES)


def drawn(rng, path):
    """A file that defines some names and calls others' names."""
    if path.endswith(".tf"):
        return "".join(f'variable "v{i}" {{}}\n' for i in range(3) if rng.random() < 0.6) + f'resource "kind" "{rng.choice("xy")}" {{\n  a = var.v{rng.randrange(3)}\n}}\n'
    module = rng.choice("abcd")
    text = f"from {module} import f0, f1\nimport {rng.choice('abcde')}\n"
    for i in range(3):
        if rng.random() < 0.7:
            text += f"def f{i}():\n    f{rng.randrange(3)}()\n    {module}.f2()\n    lost{rng.randrange(2)}()\n"
    return text


def rows(graph):
    """All that a graph says, but for the time of indexing."""
    return {
        "nodes": sorted(map(repr, graph.nodes.select(*sorted(graph.nodes.columns)).collect())),
        "edges": sorted(map(repr, graph.edges.select(*sorted(graph.edges.columns)).collect())),
        "repositories": sorted(map(repr, graph.repositories.select("name", "branch", "commit", "root_path").collect())),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_refresh_is_a_full_build(spark, tmp_path, seed):
    rng = random.Random(seed)
    paths = ["a.py", "b.py", "c.py", "d.py", "one.tf", "two.tf"]
    sources = {p: drawn(rng, p) for p in paths[:5]}
    store = GraphStore(spark, str(tmp_path / "graph"))
    store.write(index_files(table(spark, sources))[0])
    for _ in range(2):
        gone = [p for p in sorted(sources) if rng.random() < 0.2]
        given = {p: drawn(rng, p) for p in paths if p not in gone and rng.random() < 0.5}
        sources = {p: t for p, t in (sources | given).items() if p not in gone}
        removed = spark.createDataFrame([(f"r:main:{p}",) for p in gone], "file_id string")
        new, status = refresh(store.read(), table(spark, {p: sources[p] for p in set(given) | set(rng.sample(sorted(sources), 1))}), removed=removed)
        store.write(new)
        assert rows(store.read()) == rows(index_files(table(spark, sources))[0])


def test_other_files_edges_follow_a_definition(spark):
    before = {"a.py": "def f():\n    pass\n", "b.py": "from a import f, g\nf()\ng()\n"}
    graph = index_files(table(spark, before))[0]
    calls = lambda g: {r.target_id for r in g.edges.where("source_id = 'r:main:b.py' and rel_type = 'CALLS'").collect()}
    assert calls(graph) == {"r:main:a.py:f", "module:a.g"}
    new, status = refresh(graph, table(spark, {"a.py": "def g():\n    pass\n"}))
    assert calls(new) == {"module:a.f", "r:main:a.py:g"} and [r.status for r in status.collect()] == ["refreshed"]
    stubs = {r.id: r.category for r in new.nodes.where("category <> 'symbol'").collect()}
    assert "module:a.f" in stubs and "module:a.g" not in stubs
    new, _ = refresh(new, table(spark, {}), removed=spark.createDataFrame([("r:main:a.py",)], "file_id string"))
    assert calls(new) == {"module:a.f", "module:a.g"} and not new.nodes.where("id like 'r:main:a.py%'").count()


def test_nothing_changed(spark):
    graph = index_files(table(spark, {"a.py": "def f():\n    g()\n"}))[0]
    same, status = refresh(graph, table(spark, {"a.py": "def f():\n    g()\n"}))
    assert rows(same) == rows(graph) and [r.status for r in status.collect()] == ["up_to_date"]
    assert rows(repair(graph, spark.createDataFrame([], "file_id string"), graph.symbols.limit(0), graph.references.limit(0))) == rows(graph)


def test_many_files_are_removed_as_one_by_one(spark):
    sources = {p: drawn(random.Random(i), p) for i, p in enumerate(["a.py", "b.py", "c.py", "d.py"])} | {"a.py.py": "def f0():\n    pass\n"}
    graph = index_files(table(spark, sources))[0]
    gone = ["r:main:a.py", "r:main:c.py"]
    files = spark.createDataFrame([(g,) for g in [*gone, gone[0], "r:main:nothing.py"]], "file_id string")
    for keep in (False, True):
        one = graph
        for g in gone:
            one = remove_file_symbols(one, g, keep)
        many = remove_files(graph, files, keep)
        for a, b in ((one.nodes, many.nodes), (one.edges, many.edges)):
            assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
    assert many.nodes.where(F.col("id").startswith("r:main:a.py.py")).count() == 2
