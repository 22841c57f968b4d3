"""What a client works out from answers it has: paging, truncation, stages, typed nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages in order, and the states that one can be in.
STAGES = ("import", "parse", "analyze", "project")
STAGE_STATES = ("locked", "running", "done", "failed", "ready")


def has_next_page(returned: Column, page_size: int) -> Column:
    """A full page may be followed by another; there is no total to compare with."""
    return returned == page_size


def is_truncated(total: Column, loaded: Column) -> Column:
    """Whether more nodes exist than were loaded; unknown totals count as not truncated."""
    return F.coalesce(total > loaded, F.lit(False))


def stage_state(unlocked: Column, pending: Column, done: Column, error: Column) -> Column:
    """locked until the stage before is done, then running, done, failed or ready, in that order."""
    return F.when(~unlocked, "locked").when(pending, "running").when(done, "done").when(error.isNotNull() & (error != ""), "failed").otherwise("ready")


def pipeline_states(rows: DataFrame) -> DataFrame:
    """rows: `key` and, for each stage, <stage>_done, <stage>_pending, <stage>_error.  Adds <stage>_state."""
    unlocked = F.lit(True)
    out = rows
    for stage in STAGES:
        out = out.withColumn(f"{stage}_state", stage_state(unlocked, F.col(f"{stage}_pending"), F.col(f"{stage}_done"), F.col(f"{stage}_error")))
        unlocked = F.col(f"{stage}_done")
    return out


def typed_nodes(rows: DataFrame) -> DataFrame:
    """rows: id, kind, properties (text map).  The fields of each kind, null where absent or of another type."""
    bag = F.col("properties")
    of = {"repository": ("display_name", "project_id", "projected_at"), "file": ("path", "language"), "symbol": ("name", "qualified_name", "file_id")}
    columns = [F.when(F.col("kind") == kind, bag[name]).alias(name) for kind, names in of.items() for name in names]
    symbol = F.col("kind") == "symbol"
    return rows.select(
        "id", F.when(F.col("kind").isin(*of), F.col("kind")).otherwise("unknown").alias("kind"), *columns,
        F.when(F.col("kind") == "file", F.coalesce(bag["has_syntax_errors"] == "true", F.lit(False))).alias("has_syntax_errors"),
        F.when(symbol, bag["kind"]).alias("symbol_kind"), *[F.when(symbol, bag[n].try_cast("int")).alias(n) for n in ("start_line", "end_line")],
    )


def node_properties(nodes: DataFrame) -> DataFrame:
    """graph_nodes with the properties of each node as one text map; nulls are not stored."""
    from ..functions.shaping import properties

    columns = [c for c in nodes.columns if c not in ("id", "kind", "repository_id", "symbol_kind")]
    bag = properties(columns, tuple(f.name for f in nodes.schema if f.dataType.typeName() == "timestamp"))
    own = F.when(F.col("symbol_kind").isNotNull(), F.map_concat(bag, F.create_map(F.lit("kind"), F.col("symbol_kind")))).otherwise(bag)
    return nodes.select("id", "kind", "repository_id", own.alias("properties"))
