"""What the service answers: rows renamed, flattened and nested into the shapes that clients see.

Symbols lose their bases and calls; nodes and relationships get a property map in place of
their columns.  Each function takes rows of the engine's tables or operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shaping import iso_time
from ..operators.views import node_properties

SYMBOL = ["id", "kind", "name", "qualified_name", "start_line", "end_line", "start_column", "end_column"]
EDGE = [
    "id", "repository_id", "kind", "resolution_status", "source_file_id", "source_symbol_id", "target_file_id", "target_symbol_id",
    "raw_target_expression", "start_line", "end_line", "start_column", "end_column", "detail",
]


def symbols(rows: DataFrame) -> DataFrame:
    """rows: symbols with their parameters, as listings.children() gives them."""
    parameters = F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["position"].alias("position"), p["annotation"].alias("annotation"), p["default_value"].alias("default_value")))
    return rows.select(*SYMBOL, parameters.alias("parameters"), "parent_symbol_id")


def files(rows: DataFrame, repository_id: str) -> DataFrame:
    return rows.select("id", F.lit(repository_id).alias("repository_id"), "path", "language", "has_syntax_errors", "symbol_count", "import_count")


def dependencies(rows: DataFrame) -> DataFrame:
    return rows.select(*EDGE)


def nodes(rows: DataFrame) -> DataFrame:
    """id, kind, repository_id, properties."""
    return node_properties(rows)


def node_struct(rows: DataFrame) -> DataFrame:
    """(id, node) with the node as one value."""
    return nodes(rows).select(F.col("id"), F.struct("id", "kind", "repository_id", "properties").alias("node"))


def relationships(rows: DataFrame) -> DataFrame:
    """source_id, target_id, kind, repository_id, dependency_edge_id, properties."""
    return rows.select("source_id", "target_id", "kind", "repository_id", "dependency_edge_id", relationship_properties().alias("properties"))


def relationship_properties() -> Column:
    bag = F.create_map(F.lit("raw_target_expression"), F.col("raw_target_expression"))
    return F.map_filter(bag, lambda _, v: v.isNotNull())


def neighbors(found: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """found: as graph.neighbors() gives it."""
    return found.join(node_struct(graph_nodes), "id").orderBy("id", "relationship_kind", "direction", "dependency_edge_id").select("node", "relationship_kind", "direction")


def impacted(found: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """found: as graph.impact() gives it."""
    return found.join(node_struct(graph_nodes), "id").orderBy("depth", "id").select("node", "depth", F.col("kind").alias("relationship_kind"))


def degrees(found: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """found: (id, degree) as the rankings of graph give them."""
    return found.select("id", "degree").join(node_struct(graph_nodes), "id").orderBy(F.desc("degree"), "id").select("node", "degree")


def mutual_pairs(found: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """found: (first_id, second_id) as graph.mutual_pairs() gives it."""
    a = node_struct(graph_nodes).select(F.col("id").alias("first_id"), F.col("node").alias("file_a"))
    b = node_struct(graph_nodes).select(F.col("id").alias("second_id"), F.col("node").alias("file_b"))
    return found.join(a, "first_id").join(b, "second_id").orderBy("first_id", "second_id").select("file_a", "file_b")


def path(found: DataFrame, graph_nodes: DataFrame, graph_edges: DataFrame, source_id: str, target_id: str) -> DataFrame:
    """One row: source_id, target_id, found, nodes, relationships, length.

    found: as graph.shortest_path() gives it, a row with lists of at most a path's length."""
    nodes_met = found.select(F.posexplode("node_ids").alias("place", "id")).join(node_struct(graph_nodes), "id").select("place", F.lit(None).cast("int").alias("step"), "node", F.lit(None).alias("relationship"))
    hops = found.select(F.posexplode("kinds").alias("step", "kind"), "node_ids", "dependency_edge_ids")
    hops = hops.select("step", "kind", F.get("node_ids", F.col("step")).alias("source_id"), F.get("node_ids", F.col("step") + 1).alias("target_id"), F.get("dependency_edge_ids", F.col("step")).alias("its_edge"))
    walked = graph_edges.join(F.broadcast(hops), ["source_id", "target_id", "kind"]).where(F.col("dependency_edge_id").eqNullSafe(F.col("its_edge"))).dropDuplicates(["step"])
    whole = relationships(walked)
    taken = walked.select("step", F.struct(*[(relationship_properties().alias(c) if c == "properties" else F.col(c)) for c in whole.columns]).alias("relationship"))
    steps = taken.select(F.lit(None).cast("int").alias("place"), "step", F.lit(None).alias("node"), "relationship")
    every = nodes_met.unionByName(steps)
    inside = lambda c, at: F.transform(F.array_sort(F.collect_list(F.when(F.col(at).isNotNull(), F.struct(F.col(at).alias("at"), F.col(c).alias("it")))), by_place), lambda p: p["it"])
    lists = every.agg(inside("node", "place").alias("nodes"), inside("relationship", "step").alias("relationships"))
    return found.select("found", "length").withColumn("one", F.lit(1)).join(lists.withColumn("one", F.lit(1)), "one").select(F.lit(source_id).alias("source_id"), F.lit(target_id).alias("target_id"), "found", "nodes", "relationships", "length")


def by_place(a: Column, b: Column) -> Column:
    return a["at"] - b["at"]


def times(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with the named times as ISO 8601 text."""
    return rows.withColumns({c: iso_time(F.col(c)) for c in columns})
