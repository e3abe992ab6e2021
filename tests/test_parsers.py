import json

import pytest

from codeloom.sources.parse.dispatch import parse, parse_one, parser_for


def parsed(path, language, code, strict=False):
    s = parse_one("test-repo", "main", "abc", path, language, code.encode(), strict)
    return s.symbols, s.relationships


def targets(rels, kind):
    return [r["target_id"] for r in rels if r["rel_type"] == kind]


def test_python_definitions():
    symbols, rels = parsed("loom/shuttle.py", "python", "class Shuttle:\n    async def throw(self):\n        return 1\n\ndef wind(n): return n")
    assert [(s["type"], s["name"], s["start_line"], s["start_col"]) for s in symbols] == [("class", "Shuttle", 1, 0), ("method", "throw", 2, 4), ("function", "wind", 5, 0)]
    assert symbols[1]["parent_id"] == symbols[0]["id"] == "test-repo:main:loom/shuttle.py:Shuttle"
    ends = [i.split(":")[-1] for i in targets(rels, "DEFINES")]
    assert sorted(ends) == ["Shuttle", "Shuttle.throw", "Shuttle.throw", "wind"]  # a method by its file and by its class


def test_python_imports_and_calls():
    symbols, rels = parsed("dye.py", "python", "import colorsys, csv as table\nfrom vats.indigo import dip as soak\n\ndef run(cloth):\n    soak(cloth)\n    table.reader(cloth).line()\n    rinse()")
    assert targets(rels, "IMPORTS") == ["module:colorsys", "module:csv", "module:vats.indigo"]
    calls = [r for r in rels if r["rel_type"] == "CALLS"]
    assert [(c["target_id"], c["confidence"]) for c in calls] == [("module:vats.indigo.dip", 0.9), ("module:csv.reader(cloth).line", 0.9), ("module:csv.reader", 0.9), ("unresolved:rinse", 0.5)]
    assert {c["source_id"] for c in calls} == {"test-repo:main:dye.py:run"} and calls[0]["metadata"]["callee_name"] == "soak"


@pytest.mark.parametrize(
    "code, expected",
    [
        ("import yarn.ply\nyarn.ply.twist()", ["module:yarn.ply.twist"]),
        ("class Reel:\n    def turn(self):\n        self.stop()\n    def stop(self): ...", ["test-repo:main:m.py:Reel.stop"]),
        ("class Reel:\n    def turn(self):\n        self.gone()", ["unresolved:self.gone"]),
        ("def knot(): ...\nknot()", ["test-repo:main:m.py:knot"]),
    ],
)
def test_python_call_targets(code, expected):
    assert targets(parsed("m.py", "python", code)[1], "CALLS") == expected


def test_python_bases_in_the_order_they_are_written():
    _, rels = parsed("m.py", "python", "class Spindle:\n    pass\n\nclass Flyer(Spindle, guild.Member, metaclass=Oiled):\n    pass\n")
    assert [(r["source_id"].split(":")[-1], r["target_id"]) for r in rels if r["rel_type"] == "INHERITS"] == [
        ("Flyer", "test-repo:main:m.py:Spindle"),
        ("Flyer", "unresolved:guild.Member"),
        ("Flyer", "unresolved:metaclass=Oiled"),
    ]


def test_python_imports_from_folders_above():
    code = "from .. import gauge\nfrom ...bobbins.wound import length as how_long\nfrom tools import *\nfrom __future__ import annotations\nhow_long()\n"
    _, rels = parsed("mill/floor/north/row.py", "python", code)
    assert targets(rels, "IMPORTS") == ["module:mill.floor.gauge", "module:mill.bobbins.wound"]
    assert targets(rels, "CALLS") == ["module:mill.bobbins.wound.length"]


def test_python_nesting_and_decorators():
    code = "class A:\n  class B:\n    class C:\n      pass\n@deco()\ndef f():\n  pass"
    assert [s["id"].split(":")[-1] for s in parsed("m.py", "python", code)[0]] == ["A", "A.B", "A.B.C", "f"]
    assert "A.A.B.C" in [s["id"].split(":")[-1] for s in parsed("m.py", "python", code, strict=True)[0]]
    calls = [r for r in parsed("m.py", "python", code)[1] if r["rel_type"] == "CALLS"]
    assert calls[0]["source_id"] == "test-repo:main:m.py"


def test_yaml_objects():
    text = "kind: CronJob\napiVersion: batch/v1\nmetadata: {name: sweep-floor, namespace: mill}\n---\n# nothing\n---\nkind: ConfigMap\napiVersion: v1\ndata: {hours: '8'}\n---\njust text\n---\nreplicas: 3\n"
    symbols, rels = parsed("jobs/nightly.yml", "yaml", text)
    assert [(s["kind"], s["name"]) for s in symbols] == [("CronJob", "sweep-floor"), ("ConfigMap", "unknown")]
    assert {s["type"] for s in symbols} == {"resource"}
    assert targets(rels, "KUBERNETES_OBJECT") == [s["id"] for s in symbols]


def test_yaml_crossplane():
    head = "apiVersion: apiextensions.crossplane.io/v1\n"
    definition = head + "kind: CompositeResourceDefinition\nmetadata: {name: bales.cotton.test}\nspec: {group: cotton.test, names: {kind: Bale, plural: bales}}\n"
    steps = "  pipeline:\n  - step: weigh\n    functionRef: {name: fn-scale}\n  - step: tie\n    functionRef: {name: fn-rope}\n"
    made = head + "kind: Composition\nmetadata: {name: small-bale}\nspec:\n  compositeTypeRef: {apiVersion: cotton.test/v2, kind: Bale}\n" + steps + "  resources:\n  - name: cord\n    base: {apiVersion: rope.test/v1, kind: Cord}\n"
    assert targets(parsed("bale.yaml", "yaml", definition)[1], "DEFINES") == ["xrdtype:cotton.test:Bale"]
    _, rels = parsed("small.yaml", "yaml", made)
    assert targets(rels, "COMPOSITES") == ["xrdtype:cotton.test:Bale"]
    assert (targets(rels, "USES"), targets(rels, "CREATES")) == (["fn:fn-scale", "fn:fn-rope"], ["mrtype:rope.test/v1:Cord"])
    assert len(parsed("empty.yaml", "yaml", head + "kind: CompositeResourceDefinition\nspec: {names: }\n")[0]) == 1


WEAVE = """
provider "loom" { speed = var.speed }
variable "speed" { type = number }
data "loom_yarn" "merino" { grade = local.grade }
resource "loom_frame" "left" {
  count = var.speed > 3 ? 2 : 1
  yarn  = data.loom_yarn.merino.sku
}
locals {
  grade = "A"
  label = "${loom_frame.left.id} of ${local.grade}"
}
module "dye_house" {
  source = "../dye"
  vat    = loom_frame.left.vat
}
output "cloth" { value = module.dye_house.cloth }
"""


def test_terraform_definitions_have_addresses():
    symbols, rels = parsed("weave.tf", "hcl", WEAVE)
    addresses = {s["id"].split(":tf:")[1]: json.loads(s["metadata"]).get("tf_address") for s in symbols}
    assert addresses == {
        "provider:loom": None,
        "var:speed": "var.speed",
        "data:loom_yarn.merino": "data.loom_yarn.merino",
        "resource:loom_frame.left": "loom_frame.left",
        "local:grade": "local.grade",
        "local:label": "local.label",
        "module:dye_house": "module.dye_house",
        "output:cloth": None,
    }
    made = [t.split(":tf:")[1].split(":")[0] for t in targets(rels, "CREATES")]
    assert made == ["provider", "data", "resource", "module"], "what is created; the rest is defined"


def test_terraform_references_by_block():
    _, rels = parsed("weave.tf", "hcl", WEAVE)
    used = {}
    for r in rels:
        if r["rel_type"] == "DEPENDS_ON":
            used.setdefault(r["source_id"].split(":tf:")[1], set()).add(r["target_id"].removeprefix("tfaddr:"))
    assert used == {
        "provider:loom": {"var.speed"},
        "data:loom_yarn.merino": {"local.grade"},
        "resource:loom_frame.left": {"var.speed", "data.loom_yarn.merino"},
        "local:label": {"loom_frame.left", "local.grade"},
        "module:dye_house": {"loom_frame.left"},
        "output:cloth": {"module.dye_house"},
    }


def test_terraform_templates_comments_and_heredocs():
    code = 'resource "a" "b" {\n  # var.no\n  x = "${var.one}-$${var.not}"\n  y = <<EOT\n${local.two} }\nEOT\n  z = foo(each.value, self.x, c.d[0].e)\n  for_each = { k = module.m.out }\n  inner { v = a.b.id }\n}\n'
    _, rels = parsed("m.tf", "hcl", code)
    assert set(targets(rels, "DEPENDS_ON")) == {"tfaddr:var.one", "tfaddr:local.two", "tfaddr:c.d", "tfaddr:module.m"}


def test_go():
    code = 'package main\n\nimport (\n  "fmt"\n  str "strings"\n)\n\ntype Server struct {\n  name string\n}\ntype A = B\n\nfunc (s *Server) Start() {\n  fmt.Println("x // no")\n  s.Stop()\n  str.ToUpper(`(`)\n}\n\nfunc main() {\n  if (true) { helper() }\n}\nfunc helper() {}\n'
    symbols, rels = parsed("main.go", "go", code)
    assert [(s["type"], s["name"]) for s in symbols] == [("class", "Server"), ("method", "Start"), ("function", "main"), ("function", "helper"), ("module", "fmt"), ("module", "strings")]
    assert symbols[1]["parent_id"].endswith("main.go:Server")
    assert targets(rels, "CALLS") == ["module:fmt.Println", "unresolved:s.Stop", "module:strings.ToUpper", "test-repo:main:main.go:helper"]


def test_go_calls_on_what_calls_and_indexes_give():
    code = 'package main\n\nfunc main() {\n  db.Where(a, "x").Find(&y)\n  Map[int](z)\n  list[0].run()\n  b := []byte(s)\n  f := func(n int) (int, error) { return g(n), nil }\n}\n'
    calls = targets(parsed("main.go", "go", code)[1], "CALLS")
    assert [c.removeprefix("unresolved:") for c in calls] == ["db.Where", 'db.Where(a, "x").Find', "Map[int]", "list[0].run", "g"]


def test_unknown_language_and_errors(spark):
    with pytest.raises(ValueError):
        parser_for("cobol")
    rows = [("r", "b", "c", "bad.py", "python", b"def ("), ("r", "b", "c", "ok.py", "python", b"def f(): pass"), ("r", "b", "c", "x.md", "markdown", b"#")]
    found = parse(spark.createDataFrame(rows, "repo string, branch string, commit string, path string, language string, content binary")).collect()
    assert [r.path for r in found if r.error] == ["bad.py"]
    assert {r.path for r in found if r.symbol} == {"ok.py"}
