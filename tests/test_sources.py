"""Readers, the scan, diffs, and a small tree from source to answers."""

import json

import pytest

from wefthread import __main__ as cli
from wefthread.operators import diff
from wefthread.plans import api
from wefthread.sources import tree
from wefthread.sources.braces import Go, TypeScript
from wefthread.sources.ruby import Ruby


def named(reader, text):
    return {(s["name"], s["kind"], s["parent_name"]) for s in reader(text).read().symbols}


def called(reader, text):
    return [(c["receiver"], c["callee_name"], c["caller_name"], c["caller_parent"]) for c in reader(text).read().calls]


def flowing(reader, text):
    return {(f["flow_kind"], f["source_expr"], f["sink_expr"]) for f in reader(text).read().flows}


TS = """
import { Box, open as unlock } from './box';
import * as fs from "fs";
const path = require('path');
export class Crate extends Box implements Heavy, Held<number> {
  private count: number = 0;
  lid: Lid;
  constructor(private readonly store: Store, label: string) { super(); }
  static async lift(by: number): Promise<void> {
    const t = this.store.take(by);
    // ignored(comment)
    log(`took ${t.size(1)} of {}`, /call\\(x\\)/);
    this.lid = t.top.lid;
    return new Lid(t);
  }
}
abstract class Base { go() {} }
export interface Heavy extends Thing { weight(): number; mass?: Mass; inner: { a: string } }
export enum Colour { Red, Green }
type Id = string | number;
export const twice = (n: number): number => n * 2;
function plain(a) { return a }
"""


def test_typescript():
    got = named(TypeScript, TS)
    want = {
        ("Crate", "Class", None), ("count", "Property", "Crate"), ("lid", "Property", "Crate"), ("constructor", "Constructor", "Crate"), ("store", "Property", "Crate"),
        ("lift", "Method", "Crate"), ("go", "Method", None), ("Heavy", "Interface", None), ("weight", "Method", "Heavy"), ("mass", "Property", "Heavy"),
        ("inner", "Property", "Heavy"), ("Colour", "Enum", None), ("Id", "Type", None), ("twice", "Function", None), ("plain", "Function", None),
    }
    assert got == want
    r = TypeScript(TS).read()
    by = {s["name"]: s for s in r.symbols}
    assert by["Crate"]["superclass"] == "Box" and by["Crate"]["interfaces"] == ["Heavy", "Held"] and by["Heavy"]["interfaces"] == ["Thing"]
    assert by["store"]["type_annotation"] == "Store" and by["lid"]["type_annotation"] == "Lid" and by["count"]["type_annotation"] is None
    assert by["Crate"]["is_exported"] and by["twice"]["is_exported"] and not by["plain"]["is_exported"] and not by["lift"]["is_exported"]
    assert [(i["source_path"], i["imported_names"]) for i in r.imports] == [("./box", ["Box", "unlock"]), ("fs", ["fs"]), ("path", ["path"])]
    calls = called(TypeScript, TS)
    assert ("store", "take", "lift", "Crate") in calls and (None, "Lid", "lift", "Crate") in calls and ("t", "size", "lift", "Crate") in calls
    assert not {c[1] for c in calls} & {"ignored", "call", "require"}
    flows = flowing(TypeScript, TS)
    assert ("Argument", "by", "this.store.take[arg1]") in flows and ("StringInterp", "t.size(1)", "string_interpolation") in flows
    assert ("Assignment", "t.top.lid", "this.lid") in flows and ("Return", "new Lid(t)", "return") in flows
    assert ("Argument", "b", "f[arg3]") in flowing(TypeScript, "f(a, b)") and ("FieldAccess", "a", "a.b.c") in flowing(TypeScript, "const x = a.b.c;")


GO = """package main

import (
\t"fmt"
\tio2 "io"
)

type Shape interface {
\tArea(unit string, scale int) float64
}

type Square struct {
\tside, depth float64
\tOwner *Person
}

func (s *Square) Area(unit string, scale int) float64 {
\tv := s.Owner.Name
\tif n, err := fmt.Sprint(v, scale); err != nil {
\t\treturn n, err
\t}
\tgo func() { done(`raw "call()"`) }()
\treturn 0
}
"""


def test_go():
    assert named(Go, GO) == {("Shape", "Interface", None), ("Area", "Method", "Shape"), ("Square", "Struct", None), ("side", "Property", "Square"), ("depth", "Property", "Square"), ("Owner", "Property", "Square"), ("Area", "Method", "Square")}
    r = Go(GO).read()
    assert [s["param_count"] for s in r.symbols if s["name"] == "Area"] == [2, 2]
    assert [(i["source_path"], i["imported_names"]) for i in r.imports] == [("fmt", []), ("io", ["io2"])]
    assert [c[:3] for c in called(Go, GO)] == [("fmt", "Sprint", "Area"), (None, "done", "Area")]
    flows = flowing(Go, GO)
    assert {("Assignment", "s.Owner.Name", "v"), ("FieldAccess", "s.Owner", "s.Owner.Name"), ("FieldAccess", "s", "s.Owner"), ("Return", "n, err", "return"), ("Argument", "scale", "fmt.Sprint[arg1]")} <= flows


RUBY = """
require_relative "../base"
module Shop
  class Order < Models::Base
    include Trackable
    STEPS = [Pay::Card, Ship]
    attr_reader :total, :user
    def initialize(user, note: nil)
      @user = user
    end
    def self.open(items)
      return if items.empty?
      sum = items.map { |i| i.price }
      send(:close_all, sum) unless sum.nil?
      public_send(name)
      puts "got #{sum.first} end"
      note = <<~TEXT
        not a call(1)
      TEXT
      sum
    end
  end
end
def helper; end
"""


def test_ruby():
    assert named(Ruby, RUBY) == {
        ("Shop", "Module", None), ("Order", "Class", "Shop"), ("STEPS", "Constant", "Order"), ("Pay::Card", "Constant", "Order"), ("Ship", "Constant", "Order"), ("Trackable", "Constant", "Order"),
        ("total", "Property", "Order"), ("user", "Property", "Order"), ("initialize", "Constructor", "Order"), ("open", "Method", "Order"), ("helper", "Function", None),
    }
    r = Ruby(RUBY).read()
    order = next(s for s in r.symbols if s["name"] == "Order")
    assert order["superclass"] == "Models::Base" and order["interfaces"] == ["Trackable"] and order["end_line"] == 22
    assert [i["source_path"] for i in r.imports] == ["../base"]
    calls = called(Ruby, RUBY)
    assert ("Pay", "Card", None, "Order") in calls and (None, "Ship", None, "Order") in calls and (None, "close_all", "open", "Order") in calls and ("sum", "first", "open", "Order") in calls
    assert not {c[1] for c in calls} & {"send", "public_send", "call", "name"}
    flows = flowing(Ruby, RUBY)
    assert {("Assignment", "user", "@user"), ("StringInterp", "sum.first", "string_interpolation"), ("FieldAccess", "items", "items.map { |i| i.price }"), ("Argument", "sum", "send[arg1]")} <= flows


@pytest.mark.parametrize("reader", [TypeScript, Go, Ruby])
@pytest.mark.parametrize("text", ["", "(((", "}}}", "class", "def", "func", "`${", '"#{', "a = ", "x(", "type T struct {", "é → 日本", "class A {\n constructor(", "if x\nend end"])
def test_broken_text_is_read(reader, text):
    reader(text).read()


def test_listing(tmp_path):
    for name in ("a.ts", "b/c.go", "b/c_test.go", "node_modules/x.ts", ".hidden/y.rb", "gen/z.rb", "spec/s.rb", "keep/gen.ts", "note.txt", "b/skip.go"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    (tmp_path / ".gitignore").write_text("/gen/\n*.rb\n!s.rb\n")
    (tmp_path / "b" / ".ignore").write_text("skip.go\n")
    assert tree.listing(str(tmp_path)) == ["a.ts", "b/c.go", "b/c_test.go", "gen/z.rb", "keep/gen.ts", "spec/s.rb"]
    (tmp_path / ".git").mkdir()
    assert tree.listing(str(tmp_path)) == ["a.ts", "b/c.go", "b/c_test.go", "keep/gen.ts", "spec/s.rb"]
    assert tree.listing(str(tmp_path), exclude_tests=True) == ["a.ts", "b/c.go", "keep/gen.ts"]


def test_changed_ranges():
    text = "--- a/old.go\n+++ b/new.go\n@@ -3,2 +3 @@ func\n--- x\n-y\n+z\n@@ -9,0 +8,3 @@\n+1\n+2\n+3\n--- /dev/null\n+++ b/fresh.rb\n@@ -0,0 +1 @@\n+a\n"
    assert diff.changed_ranges(text) == [("old.go", 3, 4), ("new.go", 3, 3), ("new.go", 8, 10), ("fresh.rb", 1, 1)]
    assert diff.changed_ranges("") == []


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    files = {
        "src/store.ts": "export class Store {\n  take(n: number) { return pick(n); }\n}\nfunction pick(n) { return n; }\n",
        "src/main.ts": "import { Store } from './store';\nexport class Desk {\n  constructor(private store: Store) {}\n  serve(n: number) { return this.store.take(n); }\n}\nexport function runShop(d: Desk) { d.serve(1); Ext::x; outside(2); }\n",
        "app/ghost.rb": "class Ghost\n  def method_missing(n)\n  end\n  def go\n    boo(1)\n    boo(2)\n  end\nend\nA::B.fly(1)\nclass Far\n  def x\n    A::B.fly(1)\n  end\nend\n",
        "pkg/shape.go": "package pkg\n\ntype Shape interface {\n\tArea(a int) int\n}\n\ntype Square struct{}\n\nfunc (s Square) Area(a int) int {\n\treturn a\n}\n\ntype Line struct{}\n\nfunc (l Line) Area() int {\n\treturn 1\n}\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_from_tree_to_answers(spark, repo, tmp_path, capsys):
    g = api.Graph(spark, str(tmp_path / "store"))
    assert g.status() is None
    report = g.index(str(repo))
    assert report["files"] == 4 and report["parse_errors"] == 0 and not report["up_to_date"]
    assert g.index(str(repo))["up_to_date"]
    s = {r.id: r for r in g.symbols.collect()}
    assert sorted(s) == list(range(1, len(s) + 1)) and len({r.uid for r in s.values()}) == len(s)
    edges = {(s[r.source_id].name, s[r.target_id].name, r.kind): (r.confidence, r.reason) for r in g.edges.collect()}
    assert edges[("serve", "take", "CALLS")] == (0.9, "field-type-annotation")
    assert edges[("take", "pick", "CALLS")] == (0.9, "same-file-match")
    assert edges[("go", "method_missing", "CALLS")] == (0.3, "method-missing-fallback")
    assert edges[("x", "A::B.fly", "CALLS_EXTERNAL")] == (0.0, "unresolved")
    assert edges[("Square", "Shape", "IMPLEMENTS")] == (0.85, "go-implicit-implements") and ("Line", "Shape", "IMPLEMENTS") not in edges
    assert edges[("src/main.ts", "src/store.ts", "IMPORTS")] == (1.0, "import-resolved") and edges[("src/main.ts", "Store", "IMPORTS")] == (1.0, "named-import-resolved")
    assert edges[("src", "src/main.ts", "CONTAINS")] == (1.0, "directory-contains-file")
    out = g.impact("pick")
    assert out["total_affected"] == sum(len(v) for v in out["by_depth"].values()) > 0 and out["risk"] in out["summary"]
    assert g.context("Area")["status"] == "ambiguous" and g.context("nothing")["status"] == "not_found"
    found = g.context("take")
    assert found["status"] == "found" and {x["name"] for x in found["incoming"]} >= {"serve"}
    one = g.subgraph("runShop", depth=3, max_nodes=1)
    assert one["node_count"] == 1 and one["truncated"] and g.subgraph("nothing") is None
    batch = g.impact_batch(ranges=[{"file": "src/store.ts", "start": 2, "end": 2}])
    assert [r["target"]["name"] for r in batch["results"]] == ["take"]
    with pytest.raises(ValueError):
        g.impact_batch()
    assert {r.flow_kind for r in g.dataflow("serve").collect()} == {"Return", "Argument"}
    assert g.search("store").first().name in ("Store", "store") and not {r.kind for r in g.search("src").collect()} & set(api.HIDDEN)
    assert g.embed() == len([1 for r in s.values() if r.kind not in api.HIDDEN]) and g.embed() == 0 or g.has_embeddings()
    assert g.search("Function runShop", "hybrid").count() > 0
    report = g.evaluate({"queries": [{"id": "a", "query": "runShop", "category": "exact", "relevant": [{"name": "runShop", "file_path": "src/main.ts", "kind": "Function", "in_process": True}]}, {"id": "b", "query": "src/x", "category": "mixed", "relevant": []}]}, "grouped")
    assert report["recall"] == 0.5 and report["routing_accuracy"] is not None and api.gate(report, recall=0.9)
    store_flag = ["--store", str(tmp_path / "store"), "--registry", str(tmp_path / "r.json")]
    for command in (["status"], ["query", "take"], ["clusters"], ["processes"], ["impact", "take"], ["graph-query", "select count(*) as n from symbols"]):
        assert cli.main([*store_flag, *command], spark) == 0
        json.loads(capsys.readouterr().out)
    assert cli.main([*store_flag, "graph-query", "drop table symbols"], spark) == 1
    (repo / "app" / "ghost.rb").unlink()
    after = g.index(str(repo))
    assert after["stale"] == 1 and not {r.name for r in g.symbols.collect()} & {"Ghost", "A::B.fly"}
