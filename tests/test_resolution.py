"""Parsing and resolution of small repositories, end to end through the service."""

import re
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.errors import ImportFailed, Invalid, NotFound, QueryTimeout, UnsafeArchive, WrongState
from graphloom.operators.edges import import_edges
from graphloom.operators.imports import resolve_imports
from graphloom.operators.symbols import Scope, bare_names, resolve_calls
from graphloom.plans.api import Api
from graphloom.plans.service import Engine, status_of
from graphloom.schemas import SYMBOLS
from graphloom.settings import Settings

FILES = {
    "zoo/__init__.py": "",
    "zoo/base.py": "class Beast:\n    def noise(self):\n        pass\n\ndef feed():\n    pass\n",
    "zoo/cat.py": "from .base import Beast\nfrom .base import feed\nimport os\n\nclass Cat(Beast):\n    def purr(self):\n        self.noise()\n        self.nap()\n        feed()\n        feed()\n    def nap(self):\n        missing()\n        return Beast()\n",
    "one.py": "def shared():\n    pass\n",
    "two.py": "def shared():\n    pass\n",
    "user.py": "from one import *\nfrom two import *\nimport zoo.base as zb\n\ndef run():\n    shared()\n    zb.feed()\n    a.b.c()\n    zb.nothing()\n    other.x()\n",
    "web/shape.ts": "export class Shape { draw(): void { this.paint(); } paint(): void {} }\nexport function make() { return 1; }\n",
    "web/circle.ts": "import { Shape, make } from './shape';\nimport React from 'react';\nexport class Circle extends Shape { go() { make(); this.draw(); } }\n",
    "web/loop_a.js": "import { b } from './loop_b';\nexport function a() { b(); }\n",
    "web/loop_b.js": "import { a } from './loop_a';\nexport function b() { a(); }\n",
    "notes.md": "# nothing\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    return Engine(spark, Settings(workspace_root=str(root / "w"), table_root=str(root / "t"), query_timeout_seconds=120))


@pytest.fixture(scope="module")
def repository(engine, tmp_path_factory):
    archive = tmp_path_factory.mktemp("zip") / "pets.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for name, body in FILES.items():
            z.writestr(name, body)
    project = engine.create_project("pets")
    assert engine.get_project(project["id"])["name"] == "pets"
    row = engine.import_zip(project["id"], archive)
    assert (row["status"], row["display_name"], row["meta_file_count"]) == ("ready", "pets", 11)
    with pytest.raises(WrongState):
        engine.analyze_dependencies(row["id"])
    assert engine.parse(row["id"]) == {"files_parsed": 10, "errors": 0, "symbols": 17, "imports": 10}
    return row["id"]


@pytest.fixture(scope="module")
def edges(engine, repository):
    counts = engine.analyze_dependencies(repository)
    rows = {(r.kind, r.raw_target_expression, r.start_line): r for r in engine.list_dependencies(repository, limit=1000).collect()}
    assert counts["total"] == engine.list_dependencies(repository, limit=1000).count() == counts["resolved"] + counts["ambiguous"] + counts["unresolved"]
    return rows


@pytest.fixture(scope="module")
def names(engine, repository):
    return {r.qualified_name: r.id for r in engine.list_symbols(repository, limit=1000).collect()}


def test_states(edges):
    states = {}
    for (kind, text, _), row in edges.items():
        states.setdefault((kind, text), set()).add(row.resolution_status)
    assert states == {
        ("imports", ".base"): {"resolved"}, ("imports", "os"): {"unresolved"}, ("imports", "one"): {"resolved"}, ("imports", "two"): {"resolved"},
        ("imports", "zoo.base"): {"resolved"}, ("imports", "./shape"): {"resolved"}, ("imports", "react"): {"unresolved"}, ("imports", "./loop_b"): {"resolved"}, ("imports", "./loop_a"): {"resolved"},
        ("inherits", "Beast"): {"resolved"}, ("inherits", "Shape"): {"resolved"},
        ("calls", "self.noise"): {"unresolved"}, ("calls", "self.nap"): {"resolved"}, ("calls", "feed"): {"resolved"}, ("calls", "missing"): {"unresolved"}, ("calls", "Beast"): {"resolved"},
        ("calls", "shared"): {"ambiguous"}, ("calls", "zb.feed"): {"resolved"}, ("calls", "a.b.c"): {"unresolved"}, ("calls", "zb.nothing"): {"unresolved"}, ("calls", "other.x"): {"unresolved"},
        ("calls", "this.paint"): {"resolved"}, ("calls", "make"): {"resolved"}, ("calls", "this.draw"): {"unresolved"}, ("calls", "b"): {"resolved"}, ("calls", "a"): {"resolved"},
    }


def test_ids_are_stable_and_repeated_calls_apart(engine, repository, edges):
    before = {r.id for r in edges.values()} | {r.id for r in engine.list_dependencies(repository, kind="calls", limit=1000).collect()}
    engine.parse(repository)
    engine.analyze_dependencies(repository)
    after = {r.id for r in engine.list_dependencies(repository, limit=1000).collect()}
    assert before <= after and len(after) == engine.list_dependencies(repository, limit=1000).count()


def test_lookups(engine, repository, names):
    symbol = engine.get_symbol(names["Cat.purr"])
    assert [p["name"] for p in symbol["parameters"]] == ["self"] and [c["callee_expression"] for c in symbol["calls"]] == ["self.noise", "self.nap", "feed", "feed"]
    assert [r.path for r in engine.list_files(repository).collect()] == sorted(n for n in FILES if n != "notes.md")
    assert {r.symbol_count for r in engine.list_files(repository).where("path = 'zoo/cat.py'").collect()} == {3}
    assert engine.list_parse_errors(repository).count() == 0
    with pytest.raises(NotFound) as missing:
        engine.get_symbol("nobody")
    assert status_of(missing.value) == 404 and status_of(ValueError()) == 500
    with pytest.raises(NotFound):
        engine.list_files("nowhere")


def test_graph(engine, repository, edges, names):
    counts = engine.project_graph(repository)
    assert counts["nodes"] == 1 + 10 + 17
    stats = engine.statistics(repository)
    assert stats["freshness"] == "fresh" and stats["nodes_by_kind"] == {"repository": 1, "file": 10, "symbol": 17}
    assert stats["relationships_by_kind"]["defines"] == 17 and stats["relationships_by_kind"]["inherits"] == 2 and stats["relationships_by_kind"]["imports"] == 8
    assert {r["id"] for r in engine.dependencies(repository, names["Cat"], "inherits")} == {names["Beast"]}
    assert {r["id"] for r in engine.dependents(repository, names["feed"], "calls")} == {names["Cat.purr"], names["run"]}
    assert len(engine.dependents(repository, names["feed"], "calls")) == 3
    assert {r["id"]: r["depth"] for r in engine.impact(repository, names["Beast"])} == {names["Cat"]: 1, names["Cat.nap"]: 1, names["Cat.purr"]: 2}
    path = engine.path(repository, names["Cat.purr"], names["Beast"])
    assert path["found"] and path["length"] == 2 and path["node_ids"] == [names["Cat.purr"], names["Cat.nap"], names["Beast"]]
    assert engine.path(repository, names["Beast"], names["Cat"])["found"] is False
    insights = engine.insights(repository)
    assert len(insights["mutual_imports"]) == 1 and insights["unresolved_edges"] == 8
    assert engine.list_nodes(repository, "file").count() == 10 and engine.list_relationships(repository, "imports").count() == 8
    assert len(engine.neighbors(repository, names["Cat"])) == 4 and engine.graph_available() and engine.health() == {"status": "ok"}
    with pytest.raises(NotFound):
        engine.neighbors(repository, "nobody")
    for bad in (lambda: engine.impact(repository, names["Cat"], depth=11), lambda: engine.impact(repository, names["Cat"], limit=501), lambda: engine.path(repository, names["Cat"], names["Cat"], depth=16)):
        with pytest.raises(Invalid):
            bad()
    engine.parse(repository)
    assert engine.statistics(repository)["freshness"] == "stale"


def test_time_limit(spark):
    import time

    from graphloom.plans.service import time_limit

    with pytest.raises(QueryTimeout), time_limit(spark, 0.5):
        spark.range(1 << 40).selectExpr("sum(hash(id))").collect()
    # the time runs out between two jobs: the second never runs
    with pytest.raises(QueryTimeout), time_limit(spark, 0.3):
        spark.range(3).count()
        time.sleep(1)
        spark.range(1 << 40).selectExpr("sum(hash(id))").collect()
    # ... or after the last
    with pytest.raises(QueryTimeout), time_limit(spark, 0.3):
        time.sleep(1)
    with time_limit(spark, 60):
        assert spark.range(3).count() == 3
    assert spark.range(3).count() == 3


def test_status_codes(engine, repository, names):
    """A ceiling is a rule of the service (400); a floor is part of the request's form (422)."""
    codes = {}
    for name, ask in {
        "depth above": lambda: engine.impact(repository, names["Cat"], depth=11), "limit above": lambda: engine.impact(repository, names["Cat"], limit=501),
        "depth below": lambda: engine.impact(repository, names["Cat"], depth=0), "limit below": lambda: engine.statistics(repository, 0),
        "name": lambda: engine.create_project(""), "nobody": lambda: engine.list_files("nowhere"), "scheme": lambda: engine.import_git(engine.create_project("p")["id"], "http://host/x"),
    }.items():
        with pytest.raises(Exception) as problem:
            ask()
        codes[name] = status_of(problem.value)
    assert codes == {"depth above": 400, "limit above": 400, "depth below": 422, "limit below": 422, "name": 422, "nobody": 404, "scheme": 400}
    assert status_of(ImportFailed()) == 422 and status_of(UnsafeArchive()) == 400 and status_of(WrongState()) == 409 and status_of(QueryTimeout()) == 503


def test_bindings_on_one_line_are_one_edge_each(spark):
    """Imports of one module on one line share their id; from . import a; from . import b name two files."""
    files = table(spark, [(p, "r", p, "python") for p in ("b.py", "x.py", "pkg/u.py", "pkg/a.py", "pkg/c.py")], "id string, repository_id string, path string, language string")
    rows = [("i", "r", "x.py", "b", [], "x"), ("i", "r", "x.py", "b", [], "y"), ("j", "r", "pkg/u.py", ".", ["a"], None), ("j", "r", "pkg/u.py", ".", ["c"], None)]
    imports = table(spark, [(*r, 1, 1) for r in rows], "id string, repository_id string, file_id string, module string, imported_names array<string>, alias string, start_line int, end_line int")
    resolved = resolve_imports(files, imports)
    edges = import_edges(resolved).collect()
    assert sorted((e.source_file_id, e.target_file_id, e.resolution_status) for e in edges) == [("pkg/u.py", "pkg/a.py", "resolved"), ("pkg/u.py", "pkg/c.py", "resolved"), ("x.py", "b.py", "resolved"), ("x.py", "b.py", "resolved")]
    assert len({e.id for e in edges}) == 4
    bound = {(r.file_id, r.bound, r.target_file_id) for r in Scope(spark.createDataFrame([], SYMBOLS), resolved).bindings.collect()}
    assert bound == {("x.py", "x", "b.py"), ("x.py", "y", "b.py"), ("pkg/u.py", "a", "pkg/a.py"), ("pkg/u.py", "c", "pkg/c.py")}


def test_whole_files(engine, repository):
    whole = {r.path: r for r in engine.load_files(repository).collect()}
    assert set(whole) == {n for n in FILES if n != "notes.md"} and whole["zoo/__init__.py"].symbols == []
    cat = whole["zoo/cat.py"]
    assert [s.name for s in cat.symbols] == ["Cat", "purr", "nap"] and sorted(i.module for i in cat.imports) == [".base", ".base", "os"]
    assert [c.callee_expression for c in cat.symbols[1].calls] == ["self.noise", "self.nap", "feed", "feed"] and cat.symbols[1].parameters[0].name == "self"


def test_upload(engine, tmp_path):
    body = tmp_path / "up.zip"
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("a.py", "x = 1")
    project = engine.create_project("uploads")
    with body.open("rb") as stream:
        row = engine.upload_zip(project["id"], "mine.zip", stream)
    assert (row["status"], row["display_name"], row["meta_file_count"]) == ("ready", "mine", 1)
    small = Engine(engine.spark, Settings(workspace_root=str(tmp_path / "w"), table_root=engine.settings.table_root, max_upload_bytes=10))
    with body.open("rb") as stream, pytest.raises(UnsafeArchive):
        small.upload_zip(project["id"], "mine.zip", stream)


def test_answers(engine, repository, edges, names):
    """The shapes of the answers: no bases or calls in symbols, property maps in nodes and relationships."""
    api = Api(engine)
    parsed = api.parse(repository)
    assert (parsed["file_count"], parsed["symbol_count"], parsed["import_count"], parsed["error_count"]) == (10, 17, 10, 0) and parsed["parsed_at"]
    assert api.analyze(repository)["edge_count"] == 28
    projected = api.project(repository)
    assert projected["node_count"] == 28 and projected["projected_at"]
    files = list(api.files(repository))
    assert set(files[0]) == {"id", "repository_id", "path", "language", "has_syntax_errors", "symbol_count", "import_count"} and len(files) == 10
    symbol = next(s for s in api.symbols(repository) if s["qualified_name"] == "Cat.purr")
    assert set(symbol) == {"id", "kind", "name", "qualified_name", "start_line", "end_line", "start_column", "end_column", "parameters", "parent_symbol_id"}
    assert symbol == api.symbol(symbol["id"]) and symbol["parameters"] == [{"name": "self", "position": 0, "annotation": None, "default_value": None}]
    edge = api.dependencies(repository, kind="inherits")[0]
    assert list(edge) == ["id", "repository_id", "kind", "resolution_status", "source_file_id", "source_symbol_id", "target_file_id", "target_symbol_id", "raw_target_expression", "start_line", "end_line", "start_column", "end_column", "detail"]
    assert api.dependency(edge["id"]) == edge and list(api.parse_errors(repository)) == []
    node = api.nodes(repository, "repository")[0]
    assert set(node) == {"id", "kind", "repository_id", "properties"} and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{6})?\+00:00", node["properties"]["projected_at"])
    relationship = api.relationships(repository, "inherits")[0]
    assert set(relationship) == {"source_id", "target_id", "kind", "repository_id", "dependency_edge_id", "properties"} and relationship["properties"]["raw_target_expression"] in ("Beast", "Shape")
    near = api.neighbors(repository, names["Cat"], "outgoing", "inherits")
    assert [(n["node"]["properties"]["name"], n["relationship_kind"], n["direction"]) for n in near] == [("Beast", "inherits", "outgoing")]
    impact = api.impact(repository, names["Beast"])
    assert (impact["starting_node_id"], impact["direction"], impact["max_depth"]) == (names["Beast"], "upstream", 3)
    assert sorted((n["node"]["properties"]["qualified_name"], n["depth"], n["relationship_kind"]) for n in impact["impacted_nodes"]) == [("Cat", 1, "inherits"), ("Cat.nap", 1, "calls"), ("Cat.purr", 2, "calls")]
    path = api.path(repository, names["Cat.purr"], names["Beast"])
    assert [n["properties"]["qualified_name"] for n in path["nodes"]] == ["Cat.purr", "Cat.nap", "Beast"] and path["length"] == 2 and path["found"]
    assert [(r["kind"], r["properties"]["raw_target_expression"]) for r in path["relationships"]] == [("calls", "self.nap"), ("calls", "Beast")]
    none = api.path(repository, names["Beast"], names["Cat"])
    assert (none["found"], none["nodes"], none["relationships"], none["length"]) == (False, [], [], None)
    stats = api.statistics(repository)
    assert (stats["total_nodes"], stats["total_files"], stats["total_symbols"], stats["freshness"]) == (28, 10, 17, "fresh")
    assert [k["kind"] for k in stats["relationships_by_kind"]] == ["contains", "defines", "imports", "calls", "inherits"] and stats["highest_in_degree"][0]["degree"] >= stats["highest_in_degree"][-1]["degree"]
    insights = api.insights(repository)
    assert [sorted((p["file_a"]["properties"]["path"], p["file_b"]["properties"]["path"])) for p in insights["mutual_import_pairs"]] == [["web/loop_a.js", "web/loop_b.js"]]
    assert insights["unresolved_dependency_count"] == 8 and {n["kind"] for n in insights["isolated_nodes"]} == {"file", "symbol"}
    with pytest.raises(NotFound):
        api.symbol("nobody")


def test_failed_import_leaves_nothing(engine, tmp_path):
    project = engine.create_project("broken")
    archive = tmp_path / "bad.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("../x", "x")
    with pytest.raises(Invalid):
        engine.import_zip(project["id"], archive)
    with pytest.raises(Invalid):
        engine.import_git(project["id"], "http://host/x")


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "paths, source, module, names, status, target",
    [
        (["pkg/utils.py"], "main.py", "pkg.utils", [], "resolved", "pkg/utils.py"),
        (["pkg/__init__.py"], "main.py", "pkg", [], "resolved", "pkg/__init__.py"),
        (["src/lib/deep/models.py"], "src/lib/deep/component.py", "models", [], "unresolved", None),
        (["pkg/models.py"], "pkg/a.py", ".models", [], "resolved", "pkg/models.py"),
        (["models.py"], "pkg/a.py", "..models", [], "resolved", "models.py"),
        (["pkg/x.py"], "pkg/a.py", ".", ["x"], "resolved", "pkg/x.py"),
        (["pkg/x.py"], "pkg/a.py", ".", ["x", "y"], "ambiguous", None),
        (["a/pkg/m.py", "b/pkg/m.py"], "main.py", "pkg.m", [], "ambiguous", "a/pkg/m.py"),
        (["pkg/m.py", "pkg/m/__init__.py"], "main.py", "pkg.m", [], "ambiguous", "pkg/m.py"),
        (["x/pkg/m.py", "pkg/m.py"], "main.py", "pkg.m", [], "resolved", "pkg/m.py"),
        (["pkg/m.ts"], "main.py", "pkg.m", [], "unresolved", None),
        (["lib/a.ts"], "lib/b.ts", "./a", [], "resolved", "lib/a.ts"),
        (["a.js"], "x/y/b.ts", "../../a", [], "resolved", "a.js"),
        (["lib/a/index.tsx"], "lib/b.js", "./a", [], "resolved", "lib/a/index.tsx"),
        (["lib/a.jsx"], "lib/b.js", "./a", [], "resolved", "lib/a.jsx"),
        (["lib/a.js"], "lib/b.js", "./a.js", [], "unresolved", None),
        (["a.js"], "b.js", "../a", [], "unresolved", None),
        (["react.js"], "b.js", "react", [], "unresolved", None),
    ],
)
def test_import_rules(spark, paths, source, module, names, status, target):
    language = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}
    files = table(spark, [(p, "r", p, language[p.rsplit(".", 1)[1]]) for p in {*paths, source}], "id string, repository_id string, path string, language string")
    imports = table(spark, [("i", "r", source, module, names)], "id string, repository_id string, file_id string, module string, imported_names array<string>")
    row = resolve_imports(files, imports).first()
    assert (row.resolution_status, row.target_file_id) == (status, target)


def scope(spark, symbols, imports=()):
    s = table(spark, [(f"{f}:{n}:{k}:{i}", f, p, k, n) for i, (f, n, k, p) in enumerate(symbols)], "id string, file_id string, parent_symbol_id string, kind string, name string")
    i = table(spark, [(str(k), f, a, n, "resolved", t) for k, (f, a, n, t) in enumerate(imports)], "id string, file_id string, alias string, imported_names array<string>, resolution_status string, target_file_id string")
    return Scope(s, i)


def call(spark, found, name, parent=None):
    rows = table(spark, [("f", parent, name)], "file_id string, parent_symbol_id string, name string")
    return resolve_calls(found, rows).select("result.*").first()


def test_function_before_class_and_ambiguity(spark):
    both = scope(spark, [("f", "X", "function", None), ("f", "X", "class", None)])
    assert call(spark, both, "X").target_symbol_id == "f:X:function:0"
    unclear = scope(spark, [("f", "X", "function", None), ("f", "X", "function", None), ("f", "X", "class", None)])
    assert call(spark, unclear, "X").target_symbol_id == "f:X:class:2"
    twice = scope(spark, [("f", "X", "function", None), ("f", "X", "function", None)])
    assert tuple(call(spark, twice, "X"))[:3] == ("ambiguous", None, None)


def test_methods_and_instances(spark):
    found = scope(spark, [("f", "m", "method", "C"), ("f", "d", "method", "C"), ("f", "d", "method", "C")])
    assert call(spark, found, "m").status == "unresolved"
    assert call(spark, found, "self.m", "C").status == "resolved"
    assert tuple(call(spark, found, "this.d", "C"))[:2] == ("ambiguous", "f")
    assert call(spark, found, "self.z", "C").status == call(spark, found, "self.m").status == "unresolved"


def test_imported_names(spark):
    symbols = [("g", "x", "function", None), ("h", "x", "function", None), ("k", "y", "function", None), ("k", "y", "function", None)]
    one = scope(spark, symbols, [("f", None, ["x"], "g")])
    assert call(spark, one, "x").target_file_id == "g"
    two = scope(spark, symbols, [("f", None, ["*"], "g"), ("f", None, ["*"], "h")])
    assert call(spark, two, "x").status == "ambiguous"
    repeated = scope(spark, symbols, [("f", None, ["y"], "k")])
    assert call(spark, repeated, "y").status == "unresolved"
    assert bare_names(two, table(spark, [("q", "x")], "file_id string, name string"), "function").first().result.status == "unresolved"


def test_paths_beside_a_file_are_collapsed_without_parts(spark):
    """The short way gives what the long one gives, and the folder is worked out on the side of the files."""
    from graphloom.functions.paths import collapsed, join
    from graphloom.operators.imports import beside

    folders = [".", "..", "src", "src/a", "a/./b", "../x", "a//b", ".hidden/b", "a/...", "/", "/abs/a", ""]
    modules = ["./x", "../x", "./", "../", ".", "..", "./../x", ".././x", "../../x", "../../../x", "./a//b", "./a/..", "../a/./b", "./.x", "../..x", "./a/", "./a/...", ".x"]
    rows = spark.createDataFrame([(f, m) for f in folders for m in modules], "f string, m string")
    f, m = F.col("f"), F.col("m")
    assert [tuple(r) for r in rows.select("f", "m", beside(f, m).alias("got"), collapsed(join(f, m)).alias("want")).where("not got <=> want").collect()] == []
