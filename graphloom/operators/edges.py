"""Dependency edges: one per import, call and base class, resolved or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import EDGE_NAMESPACE, uuid5
from ..schemas import DEPENDENCY_EDGES
from ..scratch import stored
from .imports import resolve_imports
from .symbols import Scope, resolve_bases, resolve_calls

COLUMNS = [f.name for f in DEPENDENCY_EDGES]


def occurrence(owner: str, *order: str) -> Column:
    """Position from 0 among the rows of one owner."""
    return F.row_number().over(Window.partitionBy(owner).orderBy(*order)) - 1


def shaped(rows: DataFrame, kind: str, owner: str) -> DataFrame:
    """Rows in the schema of dependency_edges, with their identifiers."""
    parts = [F.col("repository_id"), F.lit(kind), F.col(owner), F.col("raw_target_expression"), *[F.col(c) for c in ("start_line", "end_line", "start_column", "end_column", "occurrence")]]
    return rows.withColumn("kind", F.lit(kind)).withColumn("id", uuid5(EDGE_NAMESPACE, *parts)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DEPENDENCY_EDGES])


def import_edges(resolved: DataFrame) -> DataFrame:
    """One edge per import.  Imports of a file that share an id are told apart by their occurrence."""
    numbered = resolved.withColumn("occurrence", occurrence("file_id", "id", "alias", "imported_names"))
    return shaped(
        numbered.select("repository_id", "resolution_status", F.col("file_id").alias("source_file_id"), F.lit(None).alias("source_symbol_id"), "target_file_id", F.lit(None).alias("target_symbol_id"), F.col("module").alias("raw_target_expression"), "start_line", "end_line", F.lit(None).alias("start_column"), F.lit(None).alias("end_column"), "detail", "occurrence"),
        "imports", "source_file_id",
    )


def call_edges(scope: Scope, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    callers = symbols.where("kind <> 'class'").select(F.col("id").alias("symbol_id"), "file_id", "parent_symbol_id")
    rows = calls.withColumn("occurrence", occurrence("symbol_id", "start_line", "ordinal")).withColumnRenamed("callee_expression", "name").join(callers, "symbol_id")
    found = resolve_calls(scope, rows.select("repository_id", "symbol_id", "file_id", "parent_symbol_id", "name", "start_line", "end_line", "occurrence"))
    return shaped(
        found.select("repository_id", F.col("result.status").alias("resolution_status"), F.col("file_id").alias("source_file_id"), F.col("symbol_id").alias("source_symbol_id"), "result.target_file_id", "result.target_symbol_id", F.col("name").alias("raw_target_expression"), "start_line", "end_line", F.lit(None).alias("start_column"), F.lit(None).alias("end_column"), "result.detail", "occurrence"),
        "calls", "source_symbol_id",
    )


def inheritance_edges(scope: Scope, symbols: DataFrame) -> DataFrame:
    rows = symbols.where("kind = 'class'").select("repository_id", F.col("id").alias("symbol_id"), "file_id", "start_line", "end_line", "start_column", "end_column", F.posexplode("base_class_names").alias("occurrence", "name"))
    found = resolve_bases(scope, rows)
    return shaped(
        found.select("repository_id", F.col("result.status").alias("resolution_status"), F.col("file_id").alias("source_file_id"), F.col("symbol_id").alias("source_symbol_id"), "result.target_file_id", "result.target_symbol_id", F.col("name").alias("raw_target_expression"), "start_line", "end_line", "start_column", "end_column", "result.detail", "occurrence"),
        "inherits", "source_symbol_id",
    )


def dependency_edges(files: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """All edges of the given tables.  Bad references become unresolved rows, never failures."""
    resolved = stored(resolve_imports(files, imports), "resolved-imports")  # read by the import edges and by both kinds of names
    scope = Scope(symbols, resolved)
    return import_edges(resolved).unionByName(call_edges(scope, symbols, calls)).unionByName(inheritance_edges(scope, symbols))


def status_counts(edges: DataFrame) -> DataFrame:
    """One row: edges in all and by status."""
    by = [F.count_if(F.col("resolution_status") == s).alias(s) for s in ("resolved", "ambiguous", "unresolved")]
    return edges.agg(F.count(F.lit(1)).alias("total"), *by)


def unresolved_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_if(F.col("resolution_status") == "unresolved").alias("unresolved_edges"))
