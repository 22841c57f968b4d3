"""Edges stored by both ends, in ranges of that end, for walks that read only where the frontier is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch, stored

#: A frontier of at most so many ids is written into the scan: files by their ranges, then row groups and rows.
NAMED_IDS = 1_000
#: One of at most so many is broadcast to the edges (some MB); a larger one is shuffled with them.
BROADCAST_IDS = 100_000
#: Rows that a task sorts into one range; few distinct ids pack so well that bytes say nothing about their number.
RANGE_ROWS = 500_000
COLUMNS = ["near", "far", "kind", "dependency_edge_id"]
#: Stored tables of edges by one end, and the direction in which they are walked.
SIDES = {"edges_out": "downstream", "edges_in": "upstream"}
ENDS = {"downstream": ("source_id", "target_id"), "upstream": ("target_id", "source_id")}


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (near, far, kind, dependency_edge_id), walked from near to far, without self-loops."""
    near, far = ENDS[direction]
    return edges.where("source_id <> target_id").select(F.col(near).alias("near"), F.col(far).alias("far"), "kind", "dependency_edge_id")


def zones_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First and last key and number of rows of each file that rows is read from; each file is sorted by the keys.

    The rows of each file are counted, then its first and last row are picked out as they pass: no task
    sorts or keeps what it reads, however many rows fit into the bytes of one split."""
    file, place, key = F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index"), F.struct(*keys)
    sizes = rows.groupBy(file).agg(F.count(F.lit(1)).alias("n"))  # a row for each file
    marked = rows.select(file, place.alias("place"), key.alias("key"))
    ends = marked.join(F.broadcast(sizes), "file").where("place = 0 or place = n - 1")
    return ends.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max("n").alias("n"))


class Frontier:
    """Distinct ids in a stored table; a few are known by name as well."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        few = [r["id"] for r in rows.select("id").limit(NAMED_IDS + 1).collect()]
        self.named = few if len(few) <= NAMED_IDS else None
        self.size = len(few) if self.named is not None else rows.count()


@dataclass
class Side:
    """Edges in one direction; if they lie in ranges of near, where, and the range of each file."""

    rows: DataFrame
    path: str | None = None
    zones: DataFrame | None = None

    def beginning(self, frontier: Frontier, kinds: list[str] | None = None) -> DataFrame:
        """The edges that begin in the frontier."""
        rows = self.rows
        if frontier.named is not None:
            if self.zones is not None:
                names = F.array(*[F.lit(i) for i in frontier.named])
                touched = self.zones.where(F.exists(names, lambda i: (i >= F.col("low.near")) & (i <= F.col("high.near"))))
                files = [r["file"] for r in touched.select("file").collect()]  # an id lies in few files, one with many edges in more
                rows = rows.sparkSession.read.schema(rows.schema).parquet(*[f"{self.path}/{f}" for f in files]) if files else rows.limit(0)
            rows = rows.where(F.col("near").isin(*frontier.named))
        else:
            ids = frontier.rows.select(F.col("id").alias("near"))
            rows = rows.join(F.broadcast(ids) if frontier.size <= BROADCAST_IDS else ids, "near", "left_semi")
        return rows if kinds is None else rows.where(F.col("kind").isin(*kinds))


@dataclass
class Adjacency:
    """Edges by source (out) and by target (into)."""

    out: Side
    into: Side

    def side(self, direction: str) -> Side:
        return self.into if direction == "upstream" else self.out


def adjacency(edges: DataFrame | Adjacency) -> Adjacency:
    """edges to walk on; a table is read as it lies, in either direction, so it should be a stored one."""
    return edges if isinstance(edges, Adjacency) else Adjacency(*(Side(oriented(edges, d)) for d in ("downstream", "upstream")))


def in_ranges(edges: DataFrame, direction: str) -> DataFrame:
    """Oriented edges in ranges of (near, far), so that an end with many edges is spread over files.

    edges is a stored table: it is counted first, for ranges of about RANGE_ROWS."""
    ways = oriented(edges, direction)
    ranges = ways.count() // RANGE_ROWS
    split = ways.repartitionByRange(ranges, "near", "far") if ranges > 1 else ways.repartitionByRange("near", "far")
    return split.sortWithinPartitions("near", "far")


def stored_side(edges: DataFrame, direction: str) -> Side:
    spark, path = edges.sparkSession, scratch(edges.sparkSession, f"edges-{direction}")
    in_ranges(edges, direction).write.parquet(path)
    rows = spark.read.schema("near string, far string, kind string, dependency_edge_id string").parquet(path)
    return Side(rows, path, stored(zones_of(rows, ["near"]), "zones", 1))


def stored_both(edges: DataFrame) -> Adjacency:
    """edges stored twice, by source and by target."""
    return Adjacency(*(stored_side(edges, d) for d in ("downstream", "upstream")))
