"""Hand-built graphs."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, listings
from graphloom.plans.project import attached, fitted, graph_edges, layout
from graphloom.schemas import DEPENDENCY_EDGES, GRAPH_EDGES, GRAPH_NODES, PARSED_FILES, SYMBOLS
from graphloom.sources.store import Store
from graphloom.streaming.incremental import project_stream, projected


def made(spark, edges, extra=(), kind="symbol", repository="r"):
    ids = sorted({x for e in edges for x in e[:2]} | set(extra))
    nodes = fitted(spark.createDataFrame([(i, kind, repository, i.lower()) for i in ids], "id string, kind string, repository_id string, name string"), GRAPH_NODES)
    rows = spark.createDataFrame([(a, b, k, repository, f"e{n}") for n, (a, b, k) in enumerate(edges)] or [], "source_id string, target_id string, kind string, repository_id string, dependency_edge_id string")
    return nodes, fitted(rows, GRAPH_EDGES)


def reached(spark, edges, start, direction, depth, kind=None, limit=100):
    nodes, rows = made(spark, edges)
    return [(r.id, r.depth) for r in graph.impact(nodes, rows, start, direction, depth, kind, limit).collect()]


CHAIN = [("A", "B", "calls"), ("B", "C", "calls"), ("C", "D", "calls")]


@pytest.mark.parametrize(
    "edges, start, direction, depth, kind, limit, want",
    [
        (CHAIN, "B", "downstream", 1, None, 100, [("C", 1)]),
        (CHAIN, "B", "downstream", 2, None, 100, [("C", 1), ("D", 2)]),
        (CHAIN, "C", "upstream", 2, None, 100, [("B", 1), ("A", 2)]),
        ([("A", "B", "calls"), ("B", "D", "calls"), ("A", "C", "calls"), ("C", "D", "calls")], "A", "downstream", 3, None, 100, [("B", 1), ("C", 1), ("D", 2)]),
        ([("A", "B", "calls"), ("B", "A", "calls")], "A", "downstream", 5, None, 100, [("B", 1)]),
        ([("A", "B", "calls"), ("A", "C", "imports")], "A", "downstream", 3, "calls", 100, [("B", 1)]),
        ([("A", "B", "contains"), ("A", "A", "calls")], "A", "downstream", 3, None, 100, []),
        ([("A", "B", "contains")], "A", "downstream", 3, "contains", 100, [("B", 1)]),
        ([("H", f"L{i}", "calls") for i in range(5)], "H", "downstream", 3, None, 2, [("L0", 1), ("L1", 1)]),
    ],
)
def test_impact(spark, edges, start, direction, depth, kind, limit, want):
    assert reached(spark, edges, start, direction, depth, kind, limit) == want


def test_paths(spark):
    nodes, edges = made(spark, [("A", "D", "calls"), *CHAIN])
    row = graph.shortest_path(nodes, edges, "A", "D").first()
    assert (row.found, row.length, row.node_ids, row.kinds, row.dependency_edge_ids) == (True, 1, ["A", "D"], ["calls"], ["e0"])
    nodes, edges = made(spark, CHAIN)
    assert tuple(graph.shortest_path(nodes, edges, "A", "D", 2).first()) == (False, None, None, None, None)
    assert graph.shortest_path(nodes, edges, "A", "A").first().length == 0
    assert graph.shortest_path(nodes, edges, "D", "A").first().found is False


def test_statistics(spark):
    nodes, edges = made(spark, [("A", "B", "calls"), ("A", "C", "calls"), ("A", "D", "imports"), ("A", "A", "calls")])
    assert {r.kind: r.n for r in graph.relationships_by_kind(edges).collect()} == {"contains": 0, "defines": 0, "imports": 1, "calls": 3, "inherits": 0}
    assert [(r.id, r.kind, r.degree) for r in graph.out_degrees(nodes, edges).collect()] == [("A", "symbol", 4)]
    assert {r.id: r.degree for r in graph.hotspots(nodes, edges).collect()} == {"A": 3, "B": 1, "C": 1}
    assert {r.kind: r.n for r in graph.nodes_by_kind(nodes).collect()} == {"repository": 0, "file": 0, "symbol": 4}


def test_empty_graph(spark):
    nodes, edges = made(spark, [])
    assert {r.n for r in graph.nodes_by_kind(nodes).collect()} == {0}
    for df in (graph.hotspots(nodes, edges), graph.isolated(nodes, edges), graph.mutual_pairs(edges), graph.impact(nodes, edges, "A"), graph.neighbors(nodes, edges, "A")):
        assert df.count() == 0
    assert graph.shortest_path(nodes, edges, "A", "B").first().found is False


def test_isolated_mutual_and_neighbours(spark):
    files, imports = made(spark, [("F1", "F2", "imports"), ("F2", "F1", "imports"), ("F2", "F1", "imports"), ("F1", "F3", "imports")], ["F4"], "file")
    symbols, calls = made(spark, [("S1", "S2", "calls")], ["S3"])
    nodes, edges = files.unionByName(symbols), imports.unionByName(calls)
    assert [tuple(r) for r in graph.isolated(nodes, edges).collect()] == [("F4", "file"), ("S3", "symbol")]
    assert [tuple(r) for r in graph.mutual_pairs(edges).collect()] == [("F1", "F2")]
    assert {r.id: r.degree for r in graph.most_connected_files(nodes, edges).collect()} == {"F1": 4, "F2": 3, "F3": 1}
    met = [(r.id, r.direction) for r in graph.neighbors(nodes, edges, "F1").collect()]
    assert met == [("F2", "incoming"), ("F2", "incoming"), ("F2", "outgoing"), ("F3", "outgoing")]
    looped = made(spark, [("A", "A", "calls")])
    assert [(r.id, r.direction) for r in graph.neighbors(*looped, "A").collect()] == [("A", "outgoing")]


def test_repositories_do_not_leak(spark):
    a, b = made(spark, CHAIN, repository="r"), made(spark, CHAIN, repository="q")
    nodes, edges = a[0].unionByName(b[0]), a[1].unionByName(b[1])
    assert [r.id for r in graph.impact(nodes, edges, "A", "downstream", repository_id="q").collect()] == ["B", "C", "D"]
    assert not graph.has_node(nodes, "A", "other")
    assert graph.omitted(a[0].where("id <> 'D'"), a[1]).first().omitted == 1


def test_many_edges_survive_pages(spark):
    nodes, edges = made(spark, [("A", "B", "calls")] * 40)
    pages = [listings.relationships_page(edges, "r", limit=15, offset=o).collect() for o in (0, 15, 30)]
    assert len({r.dependency_edge_id for p in pages for r in p}) == 40
    assert attached(nodes, edges).count() == 40 and attached(nodes.where("id = 'A'"), edges).count() == 0


def test_projection_uses_state_not_target(spark):
    rows = spark.createDataFrame([("1", "r", "imports", "ambiguous", "f", "g"), ("2", "r", "imports", "resolved", "f", "g"), ("3", "r", "calls", "resolved", "f", "g")], "id string, repository_id string, kind string, resolution_status string, source_file_id string, target_file_id string")
    files = fitted(spark.createDataFrame([("f", "r"), ("g", "r")], "id string, repository_id string"), PARSED_FILES)
    symbols = fitted(spark.createDataFrame([("s", "f", "r", None), ("t", "f", "r", "s")], "id string, file_id string, repository_id string, parent_symbol_id string"), SYMBOLS)
    got = sorted((r.kind, r.source_id, r.target_id) for r in graph_edges(files, symbols, fitted(rows, DEPENDENCY_EDGES)).collect())
    assert got == [("contains", "r", "f"), ("contains", "r", "g"), ("contains", "s", "t"), ("defines", "f", "s"), ("defines", "f", "t"), ("imports", "f", "g")]


def test_layout_rows(spark):
    files = made(spark, [], [f"n{i:02d}" for i in range(16)], "file")[0]
    one = made(spark, [], ["R"], "repository")[0]
    placed = {r.id: (r.x, r.y) for r in layout(files.unionByName(one)).collect()}
    assert placed["R"] == (0, 13 * 58 / 2) and placed["n00"] == (340, 0) and placed["n13"] == (340, 13 * 58) and placed["n15"] == (590, 58)


def test_store_replaces_one_partition(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.ensure()
    a, b = made(spark, CHAIN, repository="a")[1], made(spark, CHAIN, repository="b")[1]
    store.replace("graph_edges", "a", a)
    store.replace("graph_edges", "b", b)
    store.replace("graph_edges", "a", a.limit(0))
    assert store.table("graph_edges", "a").count() == 0 and store.table("graph_edges", "b").count() == 3
    assert store.table("graph_edges").columns == [f.name for f in GRAPH_EDGES]


def test_store_changes_tables_together(spark, tmp_path):
    """A save that fails half way leaves everything as it was."""
    store = Store(spark, str(tmp_path), retention=0)
    nodes, edges = made(spark, CHAIN, repository="a")
    store.replace_all("a", {"graph_nodes": nodes, "graph_edges": edges})
    held = store.table("graph_edges", "a")
    broken = edges.limit(1).withColumn("kind", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.replace_all("a", {"graph_nodes": nodes.limit(1), "graph_edges": broken})
    assert store.table("graph_nodes", "a").count() == 4 and store.table("graph_edges", "a").count() == 3
    store.replace_all("a", {"graph_nodes": nodes.limit(2), "graph_edges": edges.limit(1)})
    assert held.count() == 3, "a reader keeps the version that it has"
    assert store.table("graph_nodes").count() == 2 and store.table("graph_edges").count() == 1
    for n in (1, 2, 3):
        store.replace("graph_edges", "a", edges.limit(n))
    assert len(list((tmp_path / "graph_edges" / "repository_id=a").glob("version=*"))) == 2


def test_the_service_leaves_no_scratch_tables(spark, tmp_path):
    """After parsing, analysis, projection and walks, nothing is left of what they stored for themselves."""
    from pathlib import Path

    from graphloom.plans.service import Engine
    from graphloom.scratch import scratch_root
    from graphloom.settings import Settings

    root = Path(scratch_root(spark).removeprefix("file://")) / "graphloom"
    before = {p.name for p in root.glob("*")} if root.exists() else set()
    engine = Engine(spark, Settings(workspace_root=str(tmp_path / "ws"), table_root=str(tmp_path / "tables"), query_timeout_seconds=60))
    (tmp_path / "a.py").write_text("def f():\n    return g()\ndef g(): pass\n")
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.write(tmp_path / "a.py", "a.py")
    row = engine.import_zip(engine.create_project("p")["id"], tmp_path / "a.zip")
    engine.parse(row["id"])
    engine.analyze_dependencies(row["id"])
    engine.project_graph(row["id"])
    ids = {r.name: r.id for r in engine.store.table("symbols", row["id"]).collect()}
    assert engine.path(row["id"], ids["f"], ids["g"])["length"] == 1 and engine.get_symbol(ids["f"])["calls"][0]["callee_expression"] == "g"
    assert engine.statistics(row["id"])["highest_in_degree"] and engine.insights(row["id"])["dependency_hotspots"]
    left = {p.name.rpartition("-")[0] for p in root.glob("*") if p.name not in before}
    assert not left & {"references", "resolved-imports", "listing", "parsed", "nodes", "edges", "level", "ahead", "back", "step", "ranges"}, left
    rows, cursor = engine.page_after("symbols", row["id"], None, 1)
    more, end = engine.page_after("symbols", row["id"], cursor, 5)
    assert [r["name"] for r in rows + more] == ["f", "g"] and end is None
    placed = layout(engine.list_nodes(row["id"]))
    assert placed.count() == 4


def test_scratch_tables_go_with_their_work(spark):
    from pathlib import Path

    from graphloom.scratch import release, stored, temporary

    with temporary(spark):
        a = stored(spark.range(3), "inner")
        with temporary(spark):
            b = stored(spark.range(4), "inside")
            c = stored(spark.range(5), "kept", outlives=1)
        assert c.count() == 5 and a.count() == 3 and not Path(b.inputFiles()[0].removeprefix("file://") if b.inputFiles() else "/nowhere").exists()
        d = stored(a, "result", outlives=1)
    places = [Path(f.removeprefix("file://")) for f in d.inputFiles()]
    assert places and all(p.exists() for p in places) and d.count() == 3
    release(spark)
    assert not any(p.exists() for p in places)


def brute_path(pairs, source, target, depth):
    """Shortest path by plain breadth first search from the source; ties to the smallest predecessor."""
    level, via = {source}, {source: None}
    for _ in range(depth):
        if target in via:
            break
        new = {}
        for a, b in pairs:
            if a in level and a != b and b not in via:
                new[b] = min(new.get(b, a), a)
        via |= new
        level = set(new)
    if target not in via:
        return None
    path = [target]
    while via[path[-1]] is not None:
        path.append(via[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("stored_ways, named, broadcast", [(False, 1000, 100_000), (True, 1000, 100_000), (True, 2, 100_000), (True, 2, 0), (False, 0, 0)])
def test_paths_and_impact_over_random_graphs(spark, monkeypatch, stored_ways, named, broadcast):
    """Edges as they lie or by both ends; frontiers named, broadcast, or shuffled."""
    import random

    from graphloom.operators import adjacency

    monkeypatch.setattr(adjacency, "NAMED_IDS", named)
    monkeypatch.setattr(adjacency, "BROADCAST_IDS", broadcast)
    pick = random.Random(named)
    names = [f"n{i:02d}" for i in range(40)]
    pairs = sorted({(pick.choice(names), pick.choice(names)) for _ in range(70)})
    nodes, _ = made(spark, [], names)
    edges = fitted(spark.createDataFrame([(a, b, "calls", "r") for a, b in pairs], "source_id string, target_id string, kind string, repository_id string"), GRAPH_EDGES)
    ways = adjacency.stored_both(edges) if stored_ways else edges
    asked = [(pick.choice(names), pick.choice(names), pick.choice([2, 5, 9])) for _ in range(5)] + [(*pairs[0], 1)]
    for source, target, depth in asked:
        found = graph.shortest_path(nodes, ways, source, target, depth).first()
        want = brute_path(pairs, source, target, depth)
        assert (found.node_ids, found.length, found.found) == (want, len(want) - 1 if want else None, want is not None)
    for direction in ("upstream", "downstream"):
        near = {}
        for a, b in pairs:
            near.setdefault(b if direction == "upstream" else a, set()).add(a if direction == "upstream" else b)
        depths, level = {names[0]: 0}, {names[0]}
        for d in (1, 2, 3):
            level = set().union(*[near.get(n, set()) for n in level]) - depths.keys()
            depths |= dict.fromkeys(level, d)
        got = {r.id: r.depth for r in graph.impact(nodes, ways, names[0], direction, 3).collect()}
        assert got == {n: d for n, d in depths.items() if d}


def test_walks_read_where_the_frontier_lies(spark):
    from graphloom.operators import adjacency

    pairs = [(f"n{i:04d}", f"n{(i * 7 + 1) % 2000:04d}") for i in range(2000)]
    edges = fitted(spark.createDataFrame([(a, b, "calls", "r") for a, b in pairs], "source_id string, target_id string, kind string, repository_id string"), GRAPH_EDGES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ways = adjacency.stored_both(edges)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for side in (ways.out, ways.into):
        step = side.beginning(adjacency.Frontier(spark.createDataFrame([("n0700",), ("n0701",)], "id string")))
        assert len(step.inputFiles()) == 1 < len(side.rows.inputFiles()) and step.count() == 2


def test_ranges_hold_so_many_edges_however_well_they_pack(spark, monkeypatch):
    from graphloom.operators import adjacency

    monkeypatch.setattr(adjacency, "RANGE_ROWS", 100)
    edges = fitted(spark.createDataFrame([(f"n{i % 4}", f"m{i % 50:02d}", "calls", "r") for i in range(2000)], "source_id string, target_id string, kind string, repository_id string"), GRAPH_EDGES)
    for side, near in ((adjacency.stored_side(edges, "downstream"), "source_id"), (adjacency.stored_side(edges, "upstream"), "target_id")):
        zones = side.zones.collect()
        assert len(zones) > 10 and sum(z.n for z in zones) == 2000 and max(z.n for z in zones) <= 400
        rows = side.rows.select("near", F.col("_metadata.file_name").alias("file")).collect()
        assert {z.file: (z.low.near, z.high.near, z.n) for z in zones} == {f: (min(x := [r.near for r in rows if r.file == f]), max(x), len(x)) for f in {r.file for r in rows}}
        assert {z.low.near for z in zones} <= {r[0] for r in edges.select(near).distinct().collect()}


def test_zones_are_found_without_sorting_rows(spark, tmp_path):
    """Only the two ends of each file are sorted, so the sort stands above the join that picks them."""
    from graphloom.operators import adjacency

    spark.range(1000).selectExpr("cast(id as string) as near").sort("near").write.parquet(f"{tmp_path}/rows")
    zones = adjacency.zones_of(spark.read.parquet(f"{tmp_path}/rows"), ["near"])
    plan = zones._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "SortAggregate" not in plan[plan.index("Join") :]
    assert [(z.low.near, z.high.near, z.n) for z in zones.collect()] == [("0", "999", 1000)]


def test_walks_hold_each_import_once(spark):
    from graphloom.plans.driver_tables import Tables

    from .conftest import DATA

    t = Tables(spark, str(DATA))
    imports = t.walks("downstream").out.rows.where("kind = 'imports'").select("near", "far")
    assert imports.count() == imports.distinct().count() == t.imports.where("source_id <> target_id").select("source_id", "target_id").distinct().count() > 0


def test_numbering_over_ranges(spark, monkeypatch):
    from graphloom.plans import project

    monkeypatch.setattr(project, "RANGE_ROWS", 40)
    rows = spark.createDataFrame([("a" if i % 3 else "b", (i * 7919) % 1000, i) for i in range(500)], "g string, o int, i int")
    got = project.numbered(rows, "g", ["o", "i"], "place").collect()
    for group in ("a", "b"):
        want = sorted((r.o, r.i) for r in got if r.g == group)
        assert [(r.o, r.i) for r in sorted((r for r in got if r.g == group), key=lambda r: r.place)] == want
        assert sorted(r.place for r in got if r.g == group) == list(range(len(want)))


def test_summaries_are_merged_from_changes(spark):
    from graphloom.operators import summaries

    nodes, _ = made(spark, [], ["F1", "F2", "F3"], "file")
    nodes = nodes.unionByName(made(spark, [], ["S1", "S2", "S3"])[0])

    def table(pairs):
        return fitted(spark.createDataFrame([(a, b, k, "r") for a, b, k in pairs], "source_id string, target_id string, kind string, repository_id string"), GRAPH_EDGES)

    before = [("F1", "F2", "imports"), ("F1", "F1", "imports"), ("S1", "S2", "calls"), ("S1", "S2", "inherits"), ("S3", "S3", "calls")]
    gone, come = before[:1] + before[3:4], [("S2", "S3", "calls"), ("F2", "F1", "imports"), ("S4", "S1", "calls")]
    new, out = made(spark, [], ["S4"])[0], made(spark, [], ["F3"], "file")[0]
    after_nodes = nodes.where("id <> 'F3'").unionByName(new)
    after_edges = table([e for e in before if e not in gone] + come)
    shown = lambda df: sorted(map(tuple, df.collect()))
    merged = summaries.merged_degrees(summaries.node_degrees(nodes, table(before)), table(come), table(gone), new, out)
    whole = summaries.node_degrees(after_nodes, after_edges)
    assert shown(merged) == shown(whole)
    counts = summaries.merged_counts(summaries.kind_counts(nodes, table(before)), [("relationship", 1, table(come)), ("relationship", -1, table(gone)), ("node", 1, new), ("node", -1, out)])
    assert shown(counts) == shown(summaries.kind_counts(after_nodes, after_edges))
    for column, kind, plain in (("n_in", None, graph.in_degrees), ("n_out", None, graph.out_degrees), ("n_imports", "file", graph.most_connected_files), ("n_uses", "symbol", graph.hotspots)):
        assert [tuple(r) for r in summaries.top(whole, column, 10, kind).collect()] == [(r.id, r.kind, r.degree) for r in plain(after_nodes, after_edges, limit=10).collect()]
    assert summaries.isolated(whole).collect() == graph.isolated(after_nodes, after_edges).collect()


def test_summaries_from_shares_summed_before(spark):
    from graphloom.operators import summaries

    nodes = made(spark, [], ["F1", "F2"], "file")[0].unionByName(made(spark, [], ["S1", "S2"])[0])
    columns = "source_id string, target_id string, kind string, n long, late boolean"
    rows = [("F1", "F2", "imports", 3, False), ("F1", "F1", "imports", 2, True), ("S1", "S2", "calls", 1, False), ("S2", "S2", "calls", 4, True), ("S1", "S2", "inherits", 1, True), ("S1", "S9", "calls", 2, False)]
    counted = spark.createDataFrame(rows, columns)
    each = spark.createDataFrame([r for r in rows for _ in range(r[3])], columns)
    shown = lambda df: sorted(map(tuple, df.collect()))
    assert shown(summaries.degrees_of(nodes, summaries.shares(counted, times="n"))) == shown(summaries.node_degrees(nodes, each))
    sums = summaries.summed(summaries.shares(counted, times="n", keep="late"), "late")
    early, late = sums.where("not late").drop("late"), sums.where("late").drop("late")
    before = summaries.degrees_of(nodes, early)
    assert shown(before) == shown(summaries.node_degrees(nodes, each.where("not late")))
    assert shown(summaries.merged_shares(before, late)) == shown(summaries.node_degrees(nodes, each))
    changed = summaries.merged_shares(before, late.unionByName(summaries.taken(early)))
    assert shown(changed) == shown(summaries.merged_degrees(before, each.where("late"), each.where("not late"))) == shown(summaries.node_degrees(nodes, each.where("late")))


def test_stream_projection(spark, tmp_path):
    rows = fitted(spark.createDataFrame([("1", "r", "imports", "resolved", "f", "g"), ("2", "r", "imports", "unresolved", "f", None)], "id string, repository_id string, kind string, resolution_status string, source_file_id string, target_file_id string"), DEPENDENCY_EDGES)
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(DEPENDENCY_EDGES).parquet(f"{tmp_path}/in")
    project_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [(r.source_id, r.target_id) for r in projected(spark, f"{tmp_path}/out").collect()] == [("f", "g")]
