"""Degrees and kind counts kept beside the graph, and merged from what changes.

A summary is a sum over edges, so an edge that comes adds its share and one that goes takes
it away: merging reads the summary and the changed rows, never the unchanged edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import NODE_KINDS, RELATIONSHIP_KINDS

SUMS = ["n_in", "n_out", "n_imports", "n_uses"]


def shares(edges: DataFrame, sign: int = 1, times: str | None = None, keep: str | None = None) -> DataFrame:
    """(id, n_in, n_out, n_imports, n_uses): what each edge adds to each of its ends; sign -1 takes it away.

    times: a column that says how many equal edges a row stands for, never null; one each without it.
    keep: a column of edges that goes along."""
    loop = F.col("source_id") == F.col("target_id")
    none = F.lit(0).cast("long")
    one = (F.lit(sign) if times is None else sign * F.col(times)).cast("long")
    more = [] if keep is None else [keep]

    def end(column: str, outgoing: bool):
        counts = F.lit(True) if outgoing else ~loop  # a self-loop counts once for the undirected ones

        def of(*kinds: str):
            return F.when(F.col("kind").isin(*kinds) & counts, one).otherwise(0)

        return F.struct(
            F.col(column).alias("id"), (none if outgoing else one).alias("n_in"), (one if outgoing else none).alias("n_out"),
            of("imports").cast("long").alias("n_imports"), of("calls", "inherits").cast("long").alias("n_uses"),
        )

    return edges.select(F.explode(F.array(end("source_id", True), end("target_id", False))).alias("share"), *more).select("share.*", *more)


def summed(rows: DataFrame, *by: str) -> DataFrame:
    """Shares of each id added up; by: kept apart by these columns as well."""
    return rows.groupBy("id", *by).agg(*[F.sum(c).alias(c) for c in SUMS])


def taken(rows: DataFrame) -> DataFrame:
    """Shares taken away again."""
    return rows.select("id", *[(-F.col(c)).alias(c) for c in SUMS])


def degrees_of(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """node_degrees() from shares, summed before or not."""
    counted = nodes.select("id", "kind").dropDuplicates(["id"]).join(summed(parts), "id", "left")
    return counted.select("id", "kind", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SUMS])


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per node, zeros included: id, kind, n_in, n_out, n_imports, n_uses."""
    return degrees_of(nodes, shares(edges))


def merged_shares(before: DataFrame, changes: DataFrame, new_nodes: DataFrame | None = None, gone_nodes: DataFrame | None = None) -> DataFrame:
    """merged_degrees() from shares, summed before or not; those of edges that went are negative."""
    zeros = [F.lit(0).cast("long").alias(c) for c in SUMS]
    known = before.select("id", "kind", *SUMS)
    if new_nodes is not None:
        known = known.unionByName(new_nodes.select("id", "kind", *zeros))
    if gone_nodes is not None:
        known = known.join(gone_nodes.select("id").distinct(), "id", "left_anti")
    change = summed(changes).withColumnsRenamed({c: f"d_{c}" for c in SUMS})
    return known.join(change, "id", "left").select("id", "kind", *[(F.col(c) + F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in SUMS])


def merged_degrees(before: DataFrame, added: DataFrame, removed: DataFrame, new_nodes: DataFrame | None = None, gone_nodes: DataFrame | None = None) -> DataFrame:
    """node_degrees() after edges and nodes came and went; edges of nodes that go are among the removed.

    before: the summary so far; the other tables hold changes alone."""
    return merged_shares(before, shares(added).unionByName(shares(removed, -1)), new_nodes, gone_nodes)


def kind_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(counted, kind, n): nodes and relationships by kind, with zeros, in one aggregation of both tables."""
    rows = nodes.select(F.lit("node").alias("counted"), "kind").unionByName(edges.select(F.lit("relationship").alias("counted"), "kind"))
    return with_zeros(rows.groupBy("counted", "kind").agg(F.count(F.lit(1)).alias("n")))


def merged_counts(before: DataFrame, changes: list[tuple[str, int, DataFrame]]) -> DataFrame:
    """kind_counts() after changes: (node or relationship, 1 or -1, rows)."""
    rows = before.select("counted", "kind", "n")
    for counted, sign, changed in changes:
        rows = rows.unionByName(changed.groupBy("kind").agg((F.lit(sign) * F.count(F.lit(1))).alias("n")).select(F.lit(counted).alias("counted"), "kind", "n"))
    return with_zeros(rows.groupBy("counted", "kind").agg(F.sum("n").alias("n")))


def with_zeros(counts: DataFrame) -> DataFrame:
    names = [("node", k) for k in NODE_KINDS] + [("relationship", k) for k in RELATIONSHIP_KINDS]
    listed = counts.sparkSession.createDataFrame(names, "counted string, kind string")
    return F.broadcast(listed).join(counts, ["counted", "kind"], "left").select("counted", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_kind(counts: DataFrame, counted: str) -> DataFrame:
    return counts.where(F.col("counted") == counted).select("kind", "n")


def top(degrees: DataFrame, column: str, limit: int, kind: str | None = None) -> DataFrame:
    """Nodes by one of their sums, those with none left out: id, kind, degree."""
    rows = degrees.where(F.col(column) > 0)
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    return rows.select("id", "kind", F.col(column).alias("degree")).orderBy(F.desc("degree"), "id").limit(limit)


def isolated(degrees: DataFrame, limit: int = 20) -> DataFrame:
    """Files without an import, then symbols without a call or inheritance edge: id, kind."""
    alone = degrees.where("kind = 'file' and n_imports = 0 or kind = 'symbol' and n_uses = 0")
    return alone.orderBy(F.col("kind") == "symbol", "id").limit(limit).select("id", "kind")
