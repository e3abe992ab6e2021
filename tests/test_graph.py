import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom import cli
from codeloom.functions.columns import extension, language_of, path_to_address
from codeloom.operators import memory, queries, retrieval, traverse
from codeloom.operators.incremental import index_file, refresh
from codeloom.operators.merge import last_wins, upsert
from codeloom.plans.build import GraphStore, build, clear_repository, index_files, merge_graphs, remove_file_symbols
from codeloom.sources.scan import git_info, scan
from codeloom.streaming.refresh import refresh_on_arrival
from codeloom.tools import Tools, decode_json

FILES = {
    "main.py": "from services.order import create_order\n\ndef main():\n    create_order()\n",
    "services/order.py": "from repositories.order import save_order\nimport lost\n\ndef create_order():\n    save_order()\n    unique_name()\n",
    "repositories/order.py": "def save_order():\n    pass\n",
    "pkg/__init__.py": "def unique_name():\n    pass\n",
    "readme.md": "# x",
    ".venv/site.py": "x = 1",
    ".idea/project.json": "{}",
    ".vscode/settings.json": "{}",
    ".terraform/locks.hcl": "",
    ".github/ci.yaml": "apiVersion: v1\nkind: Deployment\nmetadata:\n  name: ci\n",
    "image.png": "x",
    "infra/main.tf": 'variable "region" {}\nresource "aws_x" "web" { r = var.region }\n',
    "x/xrd.yaml": "apiVersion: a/v1\nkind: CompositeResourceDefinition\nmetadata:\n  name: x\nspec:\n  group: g.org\n  names:\n    kind: Deployment\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def graph(spark, tree):
    built, errors = index_files(scan(spark, str(tree), "shop", "main", "c1"))
    assert errors.count() == 0
    built.nodes.persist(), built.edges.persist()
    return built


def test_scan(spark, tree):
    found = {r.path: r.language for r in scan(spark, str(tree), "shop", "main", "c").collect()}
    assert found == {"main.py": "python", "services/order.py": "python", "repositories/order.py": "python", "pkg/__init__.py": "python", "readme.md": "markdown", ".github/ci.yaml": "yaml", "infra/main.tf": "hcl", "x/xrd.yaml": "yaml", ".terraform/locks.hcl": "hcl"}


def test_git_info(tmp_path):
    assert git_info(str(tmp_path))["branch"] == "unknown"
    subprocess.run(["git", "init", "-q", "-b", "trunk", str(tmp_path)], check=True)
    (tmp_path / "a").write_text("x")
    info = git_info(str(tmp_path))
    assert info["repo_name"] == tmp_path.name and info["dirty"]


def test_columns(spark):
    df = spark.createDataFrame([("a/b.test.PY",), (".yaml",), ("x/.env.yml",), ("noext",)], "p string")
    assert [r[0] for r in df.select(extension(F.col("p"))).collect()] == [".py", "", ".yml", ""]
    assert [r[0] for r in df.select(language_of(F.col("p"))).collect()] == ["python", None, "yaml", None]
    parts = spark.createDataFrame([(["var", "a", "b"],), (["data", "t", "n", "id"],), (["self", "x"],), (["t", "n", "id"],), (["x"],)], "p array<string>")
    assert [r[0] for r in parts.select(path_to_address(F.col("p"))).collect()] == ["var.a", "data.t.n", None, "t.n", None]


def test_merge(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, "b", 1)], "k int, v string, o int")
    assert sorted(map(tuple, last_wins(rows, ["k"], "o").collect())) == [(1, None, 2), (2, "b", 1)]
    assert sorted(map(tuple, upsert(rows.where("k = 2"), rows.where("k = 1").limit(1), ["k"]).collect())) == [(1, "a", 1), (2, "b", 1)]


def test_resolution_and_trace(graph):
    calls = {(r.source_id, r.target_id): r for r in graph.edges.where("rel_type = 'CALLS'").collect()}
    step = calls["shop:main:services/order.py:create_order", "shop:main:repositories/order.py:save_order"]
    assert (step.confidence, step.resolution_status) == (0.95, "module-resolved")
    paths = traverse.trace_execution_flow(graph.edges, "shop:main:main.py:main").collect()
    assert [len(p.path) for p in paths] == [2, 3, 3]
    depends = graph.edges.where("rel_type = 'DEPENDS_ON'").first()
    assert depends.target_id.endswith("tf:var:region") and depends.resolution_status == "tf-resolved"
    lost = graph.edges.where("target_id = 'module:lost' and rel_type = 'IMPORTS'").first()
    assert (lost.confidence, lost.resolution_status) == (0.5, "unresolved")


def test_semantic_resolver(spark, tree):
    built, _ = index_files(scan(spark, str(tree), "shop", "main", "c1"), "names")
    hit = built.edges.where("resolver = 'names'").collect()
    assert [(r.target_id, r.confidence, len(r.evidence)) for r in hit] == [("shop:main:pkg/__init__.py:unique_name", 0.7, 2)]
    with pytest.raises(ValueError):
        index_files(scan(spark, str(tree), "shop", "main", "c1"), "nothing")


def test_building_twice_changes_nothing(graph):
    again = merge_graphs(graph, graph)
    for a, b, columns in ((graph.nodes, again.nodes, ["id"]), (graph.edges, again.edges, ["source_id", "rel_type", "target_id"])):
        assert sorted(map(tuple, a.select(*columns).collect())) == sorted(map(tuple, b.select(*columns).collect()))


def test_trails_have_no_repeated_edge_and_reverse(spark, graph):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "a", "CALLS"), ("a", "a", "CALLS"), ("b", "c", "IMPORTS"), ("b", "c", "CALLS")], "source_id string, target_id string, rel_type string")
    forward = traverse.trails(edges, "a", 5).collect()
    assert len({tuple(r.path) for r in forward}) <= len(forward)
    assert sum(r.node == "c" for r in forward) == sum(r.node == "a" for r in traverse.trails(edges, "c", 5, reverse=True).collect())
    assert {(r.id, r.d) for r in traverse.reachable(edges, spark.createDataFrame([("a",)], "id string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_explain(graph, tree):
    found = queries.explain_file(graph.edges, graph.nodes, graph.repositories, f"{tree}/services/order.py")
    assert found["counts"] == {"resources": 0, "classes": 0, "functions": 1}
    assert {c["target_id"] for c in found["python"]["callees"]} == {"shop:main:repositories/order.py:save_order", "unresolved:unique_name"}
    assert len(found["python"]["imports"]) == 2
    assert queries.explain_file(graph.edges, graph.nodes, graph.repositories, "/else/where.py")["error"] == "REPOSITORY_UNKNOWN"
    assert queries.explain_file(graph.edges, graph.nodes, graph.repositories, "nope.py")["error"] == "FILE_NOT_INDEXED"
    for hint in ("SHO", tree.name, None):
        assert [r.id for r in queries.find_file(graph.nodes, f"{tree}/main.py", hint, repositories=graph.repositories).collect()] == ["shop:main:main.py"]
    assert queries.find_file(graph.nodes, f"{tree}/main.py", "other", repositories=graph.repositories).count() == 0
    chain = queries.explain_file(graph.edges, graph.nodes, graph.repositories, ".github/ci.yaml")["crossplane"]
    assert [(c["role"], c["kind"]) for c in chain] == [("xrd", "Deployment")]


def test_files_explained_together_are_as_explained_alone(graph):
    files = graph.nodes.where("type = 'file'")
    rows = {r.id: r for r in queries.explain_files(graph.edges, graph.nodes, files).collect()}
    assert set(rows) == {r.id for r in files.collect()}
    seen = set()
    for id_, row in rows.items():
        one = queries.explain_file(graph.edges, graph.nodes, graph.repositories, id_.split(":", 2)[2])
        assert (row.resources, row.classes, row.functions_count) == tuple(one["counts"][k] for k in ("resources", "classes", "functions"))
        assert sorted(x.id for x in row.symbols) == sorted(x["id"] for x in one["symbols"])
        chain = [("xrd", x.id, x.of) for x in row.xrds] + [("composition", x.id, x.of) for x in row.compositions] + [("function", x.id, x.of) for x in row.functions]
        assert sorted(chain) == sorted((x["role"], x["id"], x["kind"]) for x in one["crossplane"])
        for section, other, of in (("callers", "source_id", "target_id"), ("callees", "target_id", "source_id"), ("inherits", "target_id", "source_id"), ("imports", "target_id", "source_id")):
            mine = sorted((x.id, x.of, x.confidence) for x in row[section])
            assert mine == sorted((x[other], x[of], x["confidence"]) for x in one.get("python", {}).get(section, []))
            seen |= {section} if mine else set()
    assert seen >= {"callers", "callees", "imports"}


def test_remove_and_clear(graph):
    file = "shop:main:repositories/order.py"
    less = remove_file_symbols(graph, file)
    assert less.nodes.where(F.col("id").startswith(file + ":")).count() == 0
    assert less.nodes.where(F.col("id") == file).count() == 1
    assert less.edges.where(F.col("target_id") == file + ":save_order").count() == 0
    assert remove_file_symbols(graph, file, keep_incoming=True).edges.where(F.col("target_id") == file + ":save_order").count() == 1
    empty = clear_repository(graph, "shop")
    assert empty.nodes.where("repo = 'shop'").count() == 0 and empty.repositories.count() == 0


def test_incremental_store_tools_cli(spark, graph, tree, tmp_path, capsys, monkeypatch):
    store = GraphStore(spark, str(tmp_path / "graph"))
    store.write(graph)
    path = str(tree / "repositories/order.py")
    assert index_file(store, path)["status"] == "up_to_date"
    assert index_file(store, path, force=True)["status"] == "refreshed"
    (tree / "repositories/order.py").write_text("def save_order():\n    helper()\n\ndef helper():\n    pass\n")
    assert index_file(store, path)["status"] == "refreshed"
    (tree / "new.py").write_text("from repositories.order import helper\nhelper()\n")
    assert index_file(store, "new.py", "shop")["status"] in ("error", "created")
    assert index_file(store, str(tree / "new.py"))["status"] in ("created", "up_to_date")
    calls = store.read().edges.where("rel_type = 'CALLS'").select("source_id", "target_id").collect()
    assert ("shop:main:new.py", "shop:main:repositories/order.py:helper") in [tuple(c) for c in calls]
    assert ("shop:main:services/order.py:create_order", "shop:main:repositories/order.py:save_order") in [tuple(c) for c in calls]
    for given, repo, code in (("a.py", None, "REPOSITORY_REQUIRED"), ("/outside/x.py", "shop", "FILE_OUTSIDE_REPOSITORY"), ("gone.py", "shop", "FILE_DOES_NOT_EXIST"), (".venv/site.py", "shop", "FILE_IGNORED"), ("image.png", "shop", "UNSUPPORTED_FILE_TYPE"), ("a.py", "other", "REPOSITORY_UNKNOWN")):
        assert index_file(store, given, repo)["error"] == code
    tools = Tools(store)
    assert "save_order" in tools.find_symbol("save_order") and "create_order" in tools.trace_execution_flow("shop:main:main.py:main")
    assert '"index_status": "up_to_date"' in tools.explain_file(path)
    (tree / "late.py").write_text("def late():\n    pass\n")
    first, off = json.loads(tools.explain_file(str(tree / "late.py"))), json.loads(tools.explain_file(path, index_if_missing=False))
    assert first["on_demand_indexing"]["status"] == "created" and not {"on_demand_indexing", "index_status"} & set(off)
    assert json.loads(tools.explain_file(str(tree / "gone.py")))["error"] == "FILE_DOES_NOT_EXIST"
    assert "shop" in tools.list_repositories() and "x" in tools.find_xrd("Deployment") and tools.find_compositions("Nope") == "[]"
    run = lambda *a: cli.main(["--store", store.path, *a], spark)
    assert "save_order" in run("trace", "shop:main:main.py:main") and "->" in run("trace", "shop:main:main.py:main")
    assert run("get-callers", "nobody") == "No callers found."
    assert "functions" in run("explain", "services/order.py") and '"counts"' in run("explain", "services/order.py", "--format", "json")
    assert "Deployment" in run("list-resources")
    assert "Indexed" in cli.main(["--store", str(tmp_path / "other"), "index", str(tree), "--semantic"], spark)
    assert "available" in cli.main(["--store", str(tmp_path / "other"), "index", str(tree), "--semantic", "--semantic-backend", "x"], spark)
    assert decode_json({"metadata": "{bad", "evidence": "[1]"}) == {"metadata": "{bad", "evidence": [1]}


def test_streaming_refresh(spark, tmp_path):
    fields = "repo string, branch string, commit string, root_path string, path string, language string, size bigint, content binary, content_hash string"
    text = b"def f():\n    pass\n"
    rows = [("s", "main", "c", "/s", "a.py", "python", len(text), text, "h1")]
    spark.createDataFrame(rows, fields).write.parquet(str(tmp_path / "landing"))
    store = GraphStore(spark, str(tmp_path / "graph"))
    stream = spark.readStream.schema(fields).parquet(str(tmp_path / "landing"))
    refresh_on_arrival(stream, store, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert {r.id for r in store.read().nodes.collect()} == {"s:main:a.py", "s:main:a.py:f"}
    _, status = refresh(store.read(), spark.createDataFrame(rows, fields))
    assert [r.status for r in status.collect()] == ["up_to_date"]


def test_retrieval(spark):
    store = retrieval.get_store("memory", spark)
    assert store.search("x") == []
    store.add_document("a", "Foo foo bar", {"k": "1"})
    store.add_document("b", "foo baz 9bar", {})
    store.add_document("c", "nothing", {})
    assert [(r["id"], r["score"]) for r in store.search("foo FOO bar")] == [("a", 3), ("b", 2)]
    assert [r["id"] for r in store.search("foo", filters={"k": None})] == ["b"]
    store.close()
    assert store.search("foo") == [] and retrieval.get_store("qdrant", spark).search("foo") == []
    with pytest.raises(ValueError):
        retrieval.get_store("none", spark)


def test_memory(spark, tmp_path):
    store = memory.InvestigationStore(spark, str(tmp_path))
    id_ = store.create_investigation("repo", "why?")
    store.add_message(id_, "user", "hello")
    store.add_finding(id_, "found", 0.5)
    got = store.get_investigation(id_)
    assert [m["content"] for m in got["messages"]] == ["hello"] and [f["summary"] for f in got["findings"]] == ["found"]
    assert [r["investigation_id"] for r in store.list_investigations()] == [id_] and store.get_investigation("no") is None


def test_empty_tables(spark):
    from codeloom.schemas import RELATIONSHIPS, REPOSITORIES, SYMBOLS
    from codeloom.operators.resolve import resolve_targets

    empty = lambda ddl: spark.createDataFrame([], ddl)
    keys = empty("key string, id string")
    built = build(empty(SYMBOLS), resolve_targets(empty(RELATIONSHIPS), keys, keys), empty(REPOSITORIES))
    assert built.nodes.count() == built.edges.count() == 0
