"""Graph queries over graph_nodes and graph_edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import NODE_KINDS, RELATIONSHIP_KINDS
from ..scratch import stored, temporary
from . import adjacency as adjacent
from .adjacency import Adjacency, Frontier, adjacency

#: Kinds that carry dependencies, as against mere structure.
DEPENDING = ("calls", "imports", "inherits")


def here(rows: DataFrame, repository_id: str | None) -> DataFrame:
    return rows if repository_id is None else rows.where(F.col("repository_id") == repository_id)


def of_kind(edges: DataFrame, kind: str | None, default: tuple[str, ...] | None = None) -> DataFrame:
    if kind is not None:
        return edges.where(F.col("kind") == kind)
    return edges if default is None else edges.where(F.col("kind").isin(*default))


def has_node(nodes: DataFrame, node_id: str, repository_id: str | None = None) -> bool:
    return not here(nodes, repository_id).where(F.col("id") == node_id).isEmpty()


def endpoints_exist(nodes: DataFrame, ids: list[str], repository_id: str | None = None) -> DataFrame:
    """One row: whether all ids are nodes."""
    found = here(nodes, repository_id).where(F.col("id").isin(*ids))
    return found.agg((F.count_distinct("id") == len(set(ids))).alias("all_found"))


# ---- neighbours -------------------------------------------------------------------


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, direction: str = "both", kind: str | None = None, limit: int | None = 100, repository_id: str | None = None) -> DataFrame:
    """One row per edge at a node: id, node_kind, name, relationship_kind, direction, dependency_edge_id.

    `both` shows a self-loop once, as outgoing."""
    edges, nodes = of_kind(here(edges, repository_id), kind), here(nodes, repository_id)
    out = edges.where(F.col("source_id") == node_id).select(F.col("target_id").alias("id"), "kind", "dependency_edge_id", F.lit("outgoing").alias("direction"))
    into = edges.where(F.col("target_id") == node_id)
    if direction == "both":
        into = into.where(F.col("source_id") != node_id)
    into = into.select(F.col("source_id").alias("id"), "kind", "dependency_edge_id", F.lit("incoming").alias("direction"))
    met = {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction].withColumnRenamed("kind", "relationship_kind")
    named = nodes.select("id", F.col("kind").alias("node_kind"), F.coalesce("name", "path", "display_name").alias("name"))
    rows = met.join(named, "id").orderBy("id", "relationship_kind", "direction", "dependency_edge_id")
    return rows if limit is None else rows.limit(limit)


# ---- degrees ----------------------------------------------------------------------


def undirected_degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) counting edges, not neighbours; a self-loop counts once."""
    other = F.when(F.col("source_id") != F.col("target_id"), F.array("source_id", "target_id")).otherwise(F.array("source_id"))
    return edges.select(F.explode(other).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def ranked(nodes: DataFrame, degrees: DataFrame, limit: int) -> DataFrame:
    return degrees.join(nodes.select("id", "kind"), "id").orderBy(F.desc("degree"), "id").limit(limit)


def most_connected_files(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    return ranked(nodes.where("kind = 'file'"), undirected_degrees(edges.where("kind = 'imports'")), limit)


def hotspots(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    return ranked(nodes.where("kind = 'symbol'"), undirected_degrees(edges.where("kind in ('calls', 'inherits')")), limit)


def directed_degree(nodes: DataFrame, edges: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """Top nodes by edges of any kind at one end; nodes without any are absent."""
    return ranked(nodes, edges.groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("degree")), limit)


def in_degrees(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    return directed_degree(nodes, edges, "target_id", limit)


def out_degrees(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    return directed_degree(nodes, edges, "source_id", limit)


# ---- counts -----------------------------------------------------------------------


def zero_filled(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, n) for each of the kinds, 0 where there is none."""
    counts = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    names = rows.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return F.broadcast(names).join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def nodes_by_kind(nodes: DataFrame) -> DataFrame:
    return zero_filled(nodes, NODE_KINDS)


def relationships_by_kind(edges: DataFrame) -> DataFrame:
    return zero_filled(edges, RELATIONSHIP_KINDS)


def freshness(projected_at: Column, last_parsed_at: Column) -> Column:
    """not_projected, stale (parsed strictly later) or fresh."""
    return F.when(projected_at.isNull(), "not_projected").when(last_parsed_at > projected_at, "stale").otherwise("fresh")


# ---- insights ---------------------------------------------------------------------


def isolated(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Files without an import edge, then symbols without a call or inheritance edge."""

    def touched(kinds: tuple[str, ...]) -> DataFrame:
        some = edges.where(F.col("kind").isin(*kinds))
        return some.select(F.col("source_id").alias("id")).unionByName(some.select(F.col("target_id").alias("id")))

    files = nodes.where("kind = 'file'").join(touched(("imports",)), "id", "left_anti").orderBy("id").limit(limit)
    symbols = nodes.where("kind = 'symbol'").join(touched(("calls", "inherits")), "id", "left_anti").orderBy("id").limit(limit)
    both = files.select("id", "kind", F.lit(0).alias("rank")).unionByName(symbols.select("id", "kind", F.lit(1).alias("rank")))
    return both.orderBy("rank", "id").limit(limit).select("id", "kind")


def mutual_pairs(edges: DataFrame, kind: str = "imports", limit: int | None = 20) -> DataFrame:
    """Distinct pairs first_id < second_id with an edge each way.

    One grouping by the unordered pair: no self-join is needed."""
    some = edges.where((F.col("kind") == kind) & (F.col("source_id") != F.col("target_id")))
    forward = F.col("source_id") < F.col("target_id")
    pairs = some.select(F.least("source_id", "target_id").alias("first_id"), F.greatest("source_id", "target_id").alias("second_id"), forward.alias("forward"))
    both = pairs.groupBy("first_id", "second_id").agg(F.bool_or("forward").alias("f"), F.bool_or(~F.col("forward")).alias("b")).where("f and b").select("first_id", "second_id")
    return both if limit is None else both.orderBy("first_id", "second_id").limit(limit)


def renderable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the given nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(edges.columns)


def omitted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges shown and edges left out because an end is not loaded."""
    marks = renderable(nodes, edges).select(F.lit(True).alias("kept")).unionByName(edges.select(F.lit(False).alias("kept")))
    return marks.agg(F.count_if("kept").alias("shown"), (F.count_if(~F.col("kept")) - F.count_if("kept")).alias("omitted"))


# ---- traversal --------------------------------------------------------------------


def unseen(step: DataFrame, levels: list[DataFrame], size: int) -> DataFrame:
    """Rows of step whose id is in none of the levels, which have `size` ids together."""
    known = levels[0].select("id")
    for level in levels[1:]:
        known = known.unionByName(level.select("id"))
    return step.join(F.broadcast(known) if size <= adjacent.BROADCAST_IDS else known, "id", "left_anti")


def walked(kind: str | None) -> list[str]:
    return list(DEPENDING) if kind is None else [kind]


def impact(nodes: DataFrame, edges: DataFrame | Adjacency, start: str, direction: str = "upstream", max_depth: int = 3, kind: str | None = None, limit: int | None = 100, repository_id: str | None = None) -> DataFrame:
    """Nodes reached from start, each once at its least depth: id, depth, kind.

    Breadth first, a level at a time: edges that begin in the frontier are picked out, grouped
    by where they lead, what was seen is taken away, and the new level is stored.  Edges stored by
    both ends (Adjacency) are read only where the frontier lies; others are read whole at every
    level, so they should be a stored table.  kind is the least relationship kind among the edges that
    first reach the node.  The start is never part of the result."""
    spark, kinds = nodes.sparkSession, walked(kind)
    side = (edges if isinstance(edges, Adjacency) else adjacency(here(edges, repository_id))).side(direction)
    with temporary(spark):
        frontier, seen = Frontier(spark.createDataFrame([(start, 0, None)], "id string, depth int, kind string")), 0
        levels = []
        for depth in range(1, max_depth + 1):
            levels.append(frontier.rows)
            seen += frontier.size
            met = side.beginning(frontier, kinds).groupBy(F.col("far").alias("id")).agg(F.min("kind").alias("kind"))
            frontier = Frontier(stored(unseen(met, levels, seen).select("id", F.lit(depth).alias("depth"), "kind"), "level"))
            if not frontier.size:
                break
        whole = frontier.rows
        for level in levels:
            whole = whole.unionByName(level)
        found = whole.where("depth > 0").join(here(nodes, repository_id).select("id"), "id", "left_semi")
        if limit is not None:
            found = found.orderBy("depth", "id").limit(limit)
        return stored(found, "impact", outlives=1).orderBy("depth", "id")


def shortest_path(nodes: DataFrame, edges: DataFrame | Adjacency, source: str, target: str, max_depth: int = 6, kind: str | None = None, repository_id: str | None = None) -> DataFrame:
    """One row: found, length, node_ids, kinds, dependency_edge_ids, along directed edges.

    source = target is found with length 0; without a path length and lists are null.  Ties
    go to the smallest predecessor, then the smallest kind and dependency edge.

    Two searches, from the source along the edges and from the target against them; the one with the
    smaller frontier advances until the two meet.  Of the target's side only what the source
    reaches through the meeting place counts, so each step back takes the smallest predecessor of
    all, as a search from the source alone would.  At most max_depth rows come to the driver."""
    schema = "found boolean, length int, node_ids array<string>, kinds array<string>, dependency_edge_ids array<string>"
    spark, kinds = nodes.sparkSession, walked(kind)
    if source == target:
        return spark.createDataFrame([(True, 0, [source], [], [])], schema)
    ways = edges if isinstance(edges, Adjacency) else adjacency(here(edges, repository_id))
    via = F.struct("near", "kind", F.coalesce("dependency_edge_id", F.lit("")).alias("edge"))
    with temporary(spark):
        first = [Frontier(spark.createDataFrame([(end,)], "id string")) for end in (source, target)]
        ahead, back = [first[0]], [first[1]]  # levels from the source, from the target
        steps = []  # edges (near, far, kind, dependency_edge_id) that lead from level i + 1 from the target to level i
        while len(ahead) + len(back) - 2 < max_depth:
            if ahead[-1].size <= back[-1].size:
                met = ways.out.beginning(ahead[-1], kinds).groupBy(F.col("far").alias("id")).agg(F.min(via).alias("via"))
                level = Frontier(stored(unseen(met, [x.rows for x in ahead], sum(x.size for x in ahead)).select("id", "via.*"), "ahead"))
                ahead.append(level)
            else:
                met = ways.into.beginning(back[-1], kinds).withColumnRenamed("near", "to").withColumnRenamed("far", "id")
                step = stored(unseen(met, [x.rows for x in back], sum(x.size for x in back)).select("id", F.col("to").alias("far"), "kind", "dependency_edge_id"), "step")
                level = Frontier(stored(step.select("id").distinct(), "back"))
                steps.append(step.withColumnRenamed("id", "near"))
                back.append(level)
            if not level.size:
                break
            meeting = meet(ahead[-1], back[-1])
            if not meeting.isEmpty():
                return spark.createDataFrame([traced(ahead, steps, stored(meeting, "meeting"), target)], schema)
    return spark.createDataFrame([(False, None, None, None, None)], schema)


def meet(a: Frontier, b: Frontier) -> DataFrame:
    """Ids of both frontiers: the larger one is looked through for the smaller one."""
    small, large = (a, b) if a.size <= b.size else (b, a)
    ids = small.rows.select("id")
    return large.rows.select("id").join(F.broadcast(ids) if small.size <= adjacent.BROADCAST_IDS else ids, "id", "left_semi")


def traced(ahead: list[Frontier], steps: list[DataFrame], meeting: DataFrame, target: str) -> tuple:
    """The path as a row of shortest_path(): back from the target to the meeting place, then along the stored predecessors."""
    reached = [meeting]  # nodes on shortest paths, from the meeting place towards the target
    for step in reversed(steps[1:]):
        reached.append(stored(step.join(reached[-1].select(F.col("id").alias("near")), "near", "left_semi").select(F.col("far").alias("id")).distinct(), "reached"))
    at, ids, kinds, through = target, [target], [], []

    def back_to(row) -> None:
        ids.append(row["near"])
        kinds.append(row["kind"])
        through.append(row["edge"] or None)

    order = ["near", "kind", "edge"]
    for step, known in zip(steps, reversed(reached), strict=False):
        before = step.where(F.col("far") == at).join(known.select(F.col("id").alias("near")), "near", "left_semi")
        row = before.select("near", "kind", F.coalesce("dependency_edge_id", F.lit("")).alias("edge")).orderBy(*order).first()
        back_to(row)
        at = row["near"]
    for level in reversed(ahead[1:]):
        row = level.rows.where(F.col("id") == at).first()
        back_to(row)
        at = row["near"]
    return True, len(kinds), ids[::-1], kinds[::-1], through[::-1]
