"""Listings, lookups and summaries over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal the given values; None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def page(rows: DataFrame, order: list[str | Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def symbols_page(symbols: DataFrame, repository_id: str, kind: str | None = None, file_id: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(equal(symbols, repository_id=repository_id, kind=kind, file_id=file_id), ["start_line", "id"], limit, offset)


def edges_page(edges: DataFrame, repository_id: str, kind: str | None = None, source_symbol_id: str | None = None, target_symbol_id: str | None = None, resolution_status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    found = equal(edges, repository_id=repository_id, kind=kind, source_symbol_id=source_symbol_id, target_symbol_id=target_symbol_id, resolution_status=resolution_status)
    return page(found, ["start_line", "id"], limit, offset)


def nodes_page(nodes: DataFrame, repository_id: str, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(equal(nodes, repository_id=repository_id, kind=kind), ["id"], limit, offset)


def relationships_page(edges: DataFrame, repository_id: str, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(equal(edges, repository_id=repository_id, kind=kind), ["source_id", "target_id", "kind", "dependency_edge_id"], limit, offset)


def by_id(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("id") == key)


def parse_errors(errors: DataFrame, repository_id: str) -> DataFrame:
    return equal(errors, repository_id=repository_id).select("file_path", "stage", "message")


def file_summaries(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Files with their numbers of symbols and imports, counted before they are joined."""

    def sizes(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias(name))

    joined = files.join(sizes(symbols, "symbol_count"), "id", "left").join(sizes(imports, "import_count"), "id", "left")
    return joined.select("id", "path", "language", "has_syntax_errors", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("symbol_count", "import_count")]).orderBy("path", "id")


def children(symbols: DataFrame, parameters: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols with their ordered parameters and calls as arrays."""
    ids = symbols.select(F.col("id").alias("symbol_id"))
    p = parameters.join(ids, "symbol_id", "left_semi").groupBy("symbol_id").agg(F.sort_array(F.collect_list(F.struct("position", "name", "annotation", "default_value"))).alias("parameters"))
    c = calls.join(ids, "symbol_id", "left_semi").groupBy("symbol_id").agg(F.sort_array(F.collect_list(F.struct("start_line", "ordinal", "callee_expression", "end_line"))).alias("calls"))
    whole = symbols.join(p.withColumnRenamed("symbol_id", "id"), "id", "left").join(c.withColumnRenamed("symbol_id", "id"), "id", "left")
    return whole.withColumns({"parameters": F.coalesce("parameters", F.array()), "calls": F.coalesce("calls", F.array())})


def assembled_files(files: DataFrame, symbols: DataFrame, imports: DataFrame, parameters: DataFrame, calls: DataFrame) -> DataFrame:
    """Files with nested symbols (by line, id) and imports (by id)."""
    nested = children(symbols, parameters, calls)
    s = nested.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start_line", "id", "kind", "name", "qualified_name", "parent_symbol_id", "end_line", "base_class_names", "parameters", "calls"))).alias("symbols"))
    i = imports.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("id", "module", "imported_names", "alias", "start_line", "end_line"))).alias("imports"))
    whole = files.join(s.withColumnRenamed("file_id", "id"), "id", "left").join(i.withColumnRenamed("file_id", "id"), "id", "left")
    return whole.withColumns({"symbols": F.coalesce("symbols", F.array()), "imports": F.coalesce("imports", F.array())})


def last_parsed_at(files: DataFrame) -> DataFrame:
    """One row; null if nothing was parsed."""
    return files.agg(F.max("parsed_at").alias("last_parsed_at"))


def parse_summary(files: DataFrame, errors: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """One row of counts, all tables counted in one aggregation."""
    tables = {"files_parsed": files, "errors": errors, "symbols": symbols, "imports": imports}
    marks = None
    for name, rows in tables.items():
        marked = rows.select(F.lit(name).alias("of"))
        marks = marked if marks is None else marks.unionByName(marked)
    return marks.agg(*[F.count_if(F.col("of") == name).alias(name) for name in tables])
