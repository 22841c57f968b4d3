"""Projection of the relational model into the property graph."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import adjacency, summaries
from ..schemas import GRAPH_EDGES, GRAPH_NODES
from ..scratch import stored, temporary

EDGE_KEY = ["source_id", "target_id", "kind", "dependency_edge_id"]


def fitted(rows: DataFrame, schema) -> DataFrame:
    """Columns of the schema, absent ones null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def graph_nodes(repositories: DataFrame, files: DataFrame, symbols: DataFrame, projected_at: datetime | None = None) -> DataFrame:
    """One node per repository, file and symbol."""
    repository = repositories.select("id", F.lit("repository").alias("kind"), F.col("id").alias("repository_id"), "project_id", "display_name", F.lit(projected_at).alias("projected_at"))
    file = files.select("id", F.lit("file").alias("kind"), "repository_id", "path", "language", "has_syntax_errors")
    symbol = symbols.select("id", F.lit("symbol").alias("kind"), "repository_id", "file_id", F.col("kind").alias("symbol_kind"), "name", "qualified_name", "parent_symbol_id", "start_line", "end_line")
    return fitted(repository, GRAPH_NODES).unionByName(fitted(file, GRAPH_NODES)).unionByName(fitted(symbol, GRAPH_NODES))


def structure(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """contains: repository to file, symbol to nested symbol.  defines: file to symbol."""
    contains = files.select(F.col("repository_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("kind"), "repository_id")
    defines = symbols.select(F.col("file_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("defines").alias("kind"), "repository_id")
    nested = symbols.where("parent_symbol_id is not null").select(F.col("parent_symbol_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("kind"), "repository_id")
    return fitted(contains, GRAPH_EDGES).unionByName(fitted(defines, GRAPH_EDGES)).unionByName(fitted(nested, GRAPH_EDGES))


def derived(edges: DataFrame) -> DataFrame:
    """Resolved dependency edges with both ends: files for imports, symbols for the rest."""
    resolved = edges.where("resolution_status = 'resolved' and kind in ('imports', 'calls', 'inherits')")
    file_level = F.col("kind") == "imports"
    ends = resolved.select(
        F.when(file_level, F.col("source_file_id")).otherwise(F.col("source_symbol_id")).alias("source_id"),
        F.when(file_level, F.col("target_file_id")).otherwise(F.col("target_symbol_id")).alias("target_id"),
        "kind", "repository_id", F.col("id").alias("dependency_edge_id"), "raw_target_expression",
    )
    return fitted(ends.where("source_id is not null and target_id is not null"), GRAPH_EDGES)


def graph_edges(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return structure(files, symbols).unionByName(derived(edges))


def attached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes of the same repository, once per key.  Others vanish."""
    known = nodes.select("repository_id", "id").distinct()
    both = edges.join(known.withColumnRenamed("id", "source_id"), ["repository_id", "source_id"], "left_semi").join(known.withColumnRenamed("id", "target_id"), ["repository_id", "target_id"], "left_semi")
    return both.dropDuplicates(EDGE_KEY).select(*[f.name for f in GRAPH_EDGES])


def graph_tables(repository_id: str, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All tables of a repository's graph, to be saved together: nodes and attached edges, both
    stored, the edges by both ends, and the summaries."""
    derived_ones = {
        **{name: adjacency.oriented(edges, way) for name, way in adjacency.SIDES.items()},
        "node_degrees": summaries.node_degrees(nodes, edges), "kind_counts": summaries.kind_counts(nodes, edges),
    }
    return {"graph_nodes": nodes, "graph_edges": edges} | {name: rows.withColumn("repository_id", F.lit(repository_id)) for name, rows in derived_ones.items()}


def merged_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.dropDuplicates(["id"])


# fixed values: rows before a column wraps, row height, width of a sub-column, gap between kinds
ROWS, ROW_HEIGHT, COLUMN_WIDTH, KIND_GAP = 14, 58, 250, 90
KIND_ORDER = ("repository", "file", "symbol", "unknown")


#: Rows of one range of numbered().
RANGE_ROWS = 250_000


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with their place, from 0, in the order of their group, without a task for each whole group.

    Rows are split by ranges of (group, order) and numbered inside each range; the counts of the
    ranges before it in the group, a row for each range and group, are added."""
    ranges = 1 + rows.count() // RANGE_ROWS
    split = rows if ranges == 1 else rows.repartitionByRange(ranges, group, *order)
    split = stored(split.withColumn("range", F.spark_partition_id() if ranges > 1 else F.lit(0)), "ranges")
    inside = F.row_number().over(Window.partitionBy("range", group).orderBy(*order))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = split.groupBy("range", group).agg(F.count(F.lit(1)).alias("n")).select("range", group, F.coalesce(before, F.lit(0)).alias("offset"))
    return split.withColumn("inside", inside).join(offsets, ["range", group]).withColumn(name, F.col("inside") - 1 + F.col("offset")).drop("range", "inside", "offset")


def layout(nodes: DataFrame) -> DataFrame:
    """(id, kind, x, y) for drawing: kinds left to right, each in columns of ROWS nodes, centred.

    The result is a stored table of its own; what it was made from is freed.  Symbols are ordered by file, line, label and id, other nodes by label and id.  Unknown
    kinds come last.  The same nodes always get the same places."""
    with temporary(nodes.sparkSession):
        known = F.when(F.col("kind").isin(*KIND_ORDER[:-1]), F.col("kind")).otherwise(F.lit("unknown"))
        symbol = known == "symbol"
        label = F.coalesce(F.when(symbol, F.coalesce("qualified_name", "name")), F.col("path"), F.col("display_name"), F.col("name"), F.col("id"))
        keyed = nodes.select("id", known.alias("kind"), F.when(symbol, F.coalesce("file_id", F.lit(""))).alias("f"), F.when(symbol, F.coalesce("start_line", F.lit(0))).alias("l"), label.alias("label"))
        placed = numbered(keyed, "kind", ["f", "l", "label", "id"], "place")
        # at most one row for each of the four kinds
        sizes = keyed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
        order = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
        width = F.ceil(F.col("n") / ROWS) * COLUMN_WIDTH + KIND_GAP
        before = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
        everywhere = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = F.least("n", F.lit(ROWS))
        bands = sizes.withColumn("order", order).select("kind", F.coalesce(F.sum(width).over(before), F.lit(0)).alias("left"), ((F.max(rows).over(everywhere) - rows) * ROW_HEIGHT / 2).alias("top"))
        x = F.col("left") + F.floor(F.col("place") / ROWS) * COLUMN_WIDTH
        y = F.col("top") + F.pmod("place", F.lit(ROWS)) * ROW_HEIGHT
        return stored(placed.join(F.broadcast(bands), "kind").select("id", "kind", x.cast("long").alias("x"), y.cast("double").alias("y")), "layout", outlives=1)
