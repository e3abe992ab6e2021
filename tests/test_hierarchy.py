import random

import pytest

from codeloom.operators import hierarchy
from codeloom.operators.hierarchy import ancestors, direct_bases, find_methods, look_up
from codeloom.operators.semantic import get_resolver
from codeloom.plans.build import index_files
from codeloom.plans.driver_queries import QUERIES
from codeloom.sources.scan import scan

SOURCES = {
    "stores/core.py": "class Store:\n    def load(self):\n        return self.check()\n    def check(self):\n        pass\n    def close(self):\n        pass\n",
    "stores/disk.py": "from stores.core import Store\n\nclass Disk(Store):\n    def check(self):\n        super().close()\n",
    "stores/cache.py": "from stores.disk import Disk\nfrom stores.core import Store\n\nclass Logged:\n    def close(self):\n        pass\n\nclass Cache(Disk, Logged):\n    def get(self):\n        self.load()\n        self.check()\n        self.close()\n        self.missing()\n\ndef main():\n    Cache().load()\n    Cache.get(None)\n    Disk.load(None)\n    Store.absent(None)\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("classes")
    for path, text in SOURCES.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    return index_files(scan(spark, str(root), "r", "main", "c"), "hierarchy")[0]


def test_calls_find_inherited_methods(graph):
    rows = graph.edges.where("resolver = 'hierarchy'").collect()
    at = lambda i: i.removeprefix("r:main:stores/")
    assert {(at(r.source_id), at(r.target_id)) for r in rows} == {
        ("disk.py:Disk.check", "core.py:Store.close"),
        ("cache.py:Cache.get", "core.py:Store.load"),
        ("cache.py:Cache.get", "disk.py:Disk.check"),
        ("cache.py:Cache.get", "core.py:Store.close"),
        ("cache.py:main", "core.py:Store.load"),
    }
    assert {(r.resolution_status, r.confidence, len(r.evidence)) for r in rows} == {("hierarchy-resolved", 0.9, 2)}
    left = {r.target_id for r in graph.edges.where("target_id like 'unresolved:%' or target_id like 'module:%.%.absent'").collect()}
    assert "unresolved:self.missing" in left and "module:stores.core.Store.absent" in left


def test_bases_are_resolved_across_files(graph):
    held = {(r.source_id.split(":")[-1], r.target_id.split(":")[-1]) for r in graph.edges.where("rel_type = 'INHERITS'").collect()}
    assert held == {("Disk", "Store"), ("Cache", "Disk"), ("Cache", "Logged")}


def ways(bases, c, seen):
    for n, b in enumerate(bases.get(c, [])):
        if b not in seen:
            yield b, (n,)
            for a, path in ways(bases, b, seen | {b}):
                yield a, (n, *path)


def tables(spark, bases, nodes):
    inherits = [(c, b, "INHERITS", [(1, n)]) for c, bs in bases.items() for n, b in enumerate(bs)]
    rels = spark.createDataFrame(inherits, "source_id string, target_id string, rel_type string, evidence array<struct<start_line int, start_col int>>")
    return rels, spark.createDataFrame([(n, "class") for n in nodes], "id string, type string")


@pytest.mark.parametrize("cyclic", [False, True])
def test_ancestors_by_brute_force(spark, cyclic):
    rng = random.Random(cyclic)
    nodes = [f"c{i:02}" for i in range(14)]
    bases = {c: [b for b in rng.sample(nodes if cyclic else nodes[i + 1 :], k=min(rng.randrange(3), len(nodes[i + 1 :]))) if b != c] for i, c in enumerate(nodes)}
    got = {(r["class"], r.ancestor): tuple(r.path) for r in ancestors(direct_bases(*tables(spark, bases, nodes))).collect()}
    want = {}
    for c in nodes:
        for a, path in ways(bases, c, {c}):
            want[c, a] = min(want.get((c, a), path), path)
    assert set(got) == set(want)
    if not cyclic:
        assert got == want


def test_look_up_by_brute_force_follows_python(spark):
    """Random hierarchies that Python accepts: the method found is that of Python's own order."""
    rng = random.Random(7)
    made, bases, defined = {}, {}, {}
    for i in range(25):
        c = f"k{i:02}"
        chosen = rng.sample(sorted(made), k=min(rng.randrange(3), len(made)))
        own = {m for m in "pqr" if rng.random() < 0.25}
        try:
            made[c] = type(c, tuple(made[b] for b in chosen), {m: c for m in own})
        except TypeError:
            continue
        bases[c], defined[c] = chosen, own
    methods = spark.createDataFrame([(c, m, f"{c}.{m}") for c, ms in defined.items() for m in ms], "class string, name string, id string")
    asked = [(c, m, own) for c in made for m in "pqr" for own in (True, False)]
    above = ancestors(direct_bases(*tables(spark, bases, made)))
    got = {(r["class"], r.name, r.own): r.id for r in find_methods(spark.createDataFrame(asked, "class string, name string, own boolean"), above, methods).collect()}
    want = {}
    for c, m, own in asked:
        for k in made[c].__mro__[0 if own else 1 : -1]:
            if m in vars(k):
                want[c, m, own] = f"{k.__name__}.{m}"
                break
    assert got == want


def test_nothing_to_resolve(spark):
    rels, symbols = tables(spark, {}, [])
    assert ancestors(direct_bases(rels, symbols)).isEmpty()
    assert get_resolver("jedi") is None and get_resolver("hierarchy").supports("python")


def test_odd_bases(spark):
    """A base named twice, itself, one that is no class, and one without a place."""
    rels = spark.createDataFrame(
        [("a", "b", "INHERITS", [(1, 5)]), ("a", "b", "INHERITS", [(1, 9)]), ("a", "a", "INHERITS", [(1, 7)]), ("a", "unresolved:x", "INHERITS", [(1, 1)]), ("a", "c", "INHERITS", None), ("a", "d", "INHERITS", [(1, 8)]), ("a", "d", "CALLS", [(1, 2)])],
        "source_id string, target_id string, rel_type string, evidence array<struct<start_line int, start_col int>>",
    )
    symbols = spark.createDataFrame([(x, "class") for x in "abcd"], "id string, type string")
    assert sorted((r["class"], r.base, r.nth) for r in direct_bases(rels, symbols).collect()) == [("a", "b", 0), ("a", "c", 2), ("a", "d", 1)]


@pytest.mark.parametrize("seed", range(4))
def test_look_up_from_the_top_finds_what_all_ancestors_find(spark, seed):
    """Also on and below cycles (odd seeds), for classes without bases or outside the table, and names without a definition."""
    rng = random.Random(seed)
    nodes = [f"c{i:02}" for i in range(16)]
    bases = {c: rng.sample(nodes[i + 1 :], k=min(rng.randrange(4), len(nodes[i + 1 :]))) for i, c in enumerate(nodes)}
    if seed % 2:
        bases["c12"] = ["c09", "c13"]
        bases["c09"] = ["c12", "c10"]
    methods = spark.createDataFrame([(c, m, f"{c}.{m}{n}") for c in [*nodes, "lone"] for m in "pqr" for n in range(rng.choice([0, 0, 1, 2]))], "class string, name string, id string")
    asked = spark.createDataFrame([(c, m, own) for c in [*nodes, "lone"] for m in "pqrs" for own in (True, False, True)], "class string, name string, own boolean")
    held = direct_bases(*tables(spark, bases, nodes))
    want = sorted(map(tuple, find_methods(asked, ancestors(held), methods).select("class", "name", "own", "id").collect()))
    assert sorted(map(tuple, look_up(asked, held, methods).select("class", "name", "own", "id").collect())) == want and want


def test_look_up_does_not_list_all_ancestors(spark, sf_dir, monkeypatch):
    def never(*a):
        raise AssertionError("every class met every class above it")

    monkeypatch.setattr(hierarchy, "ancestors", never)
    assert QUERIES["inherited_methods"](spark, sf_dir).count() > 0
    nothing = direct_bases(*tables(spark, {}, []))
    one = spark.createDataFrame([("a", "m", True), ("a", "m", False)], "class string, name string, own boolean")
    assert [r.own for r in look_up(one, nothing, spark.createDataFrame([("a", "m", "a.m")], "class string, name string, id string")).collect()] == [True]
