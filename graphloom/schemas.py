"""Fixed schemas of all tables.  Identifiers are lower-case 36-character UUID strings."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
}


def _schema(text: str) -> T.StructType:
    """A schema from "name type" pairs, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (pair.split(" ") for pair in text.split(", "))])


PROJECTS = _schema("id string, name string, description string, status string, created_at timestamp, updated_at timestamp")
REPOSITORIES = _schema(
    "id string, project_id string, source_type string, source_ref string, display_name string, workspace_path string, status string, error_message string, "
    "created_at timestamp, updated_at timestamp, meta_file_count int, meta_directory_count int, meta_total_size_bytes bigint, "
    "meta_language_stats map<string,double>, meta_has_readme boolean, meta_has_git boolean, meta_scanned_at timestamp"
)
PARSED_FILES = _schema("id string, repository_id string, path string, language string, has_syntax_errors boolean, parsed_at timestamp")
SYMBOLS = _schema(
    "id string, file_id string, repository_id string, parent_symbol_id string, kind string, name string, qualified_name string, "
    "start_line int, end_line int, start_column int, end_column int, base_class_names array<string>"
)
PARAMETERS = _schema("id string, symbol_id string, name string, position int, annotation string, default_value string, repository_id string")
CALL_SITES = _schema("id string, symbol_id string, callee_expression string, start_line int, end_line int, ordinal int, repository_id string")
IMPORTS = _schema("id string, file_id string, repository_id string, module string, imported_names array<string>, alias string, start_line int, end_line int")
PARSE_ERRORS = _schema("id string, repository_id string, file_path string, stage string, message string, occurred_at timestamp")
DEPENDENCY_EDGES = _schema(
    "id string, repository_id string, kind string, resolution_status string, source_file_id string, source_symbol_id string, target_file_id string, "
    "target_symbol_id string, raw_target_expression string, start_line int, end_line int, start_column int, end_column int, detail string"
)
GRAPH_NODES = _schema(
    "id string, kind string, repository_id string, project_id string, display_name string, projected_at timestamp, path string, language string, "
    "has_syntax_errors boolean, file_id string, symbol_kind string, name string, qualified_name string, parent_symbol_id string, start_line int, end_line int"
)
#: The edges by one end (near), for walks to the other.
ADJACENT_EDGES = _schema("near string, far string, kind string, dependency_edge_id string, repository_id string")
#: Edges at each node: of any kind by direction; imports, and calls with bases, either way (a self-loop once).
NODE_DEGREES = _schema("id string, kind string, n_in bigint, n_out bigint, n_imports bigint, n_uses bigint, repository_id string")
#: Nodes or relationships of each kind.
KIND_COUNTS = _schema("counted string, kind string, n bigint, repository_id string")
GRAPH_EDGES = _schema("source_id string, target_id string, kind string, repository_id string, dependency_edge_id string, raw_target_expression string")

#: Tables that a parse replaces together, per repository.
PARSE_TABLES = {
    "parsed_files": PARSED_FILES,
    "symbols": SYMBOLS,
    "parameters": PARAMETERS,
    "call_sites": CALL_SITES,
    "imports": IMPORTS,
    "parse_errors": PARSE_ERRORS,
}
TABLES = {
    "projects": PROJECTS,
    "repositories": REPOSITORIES,
    **PARSE_TABLES,
    "dependency_edges": DEPENDENCY_EDGES,
    "graph_nodes": GRAPH_NODES,
    "graph_edges": GRAPH_EDGES,
    "edges_out": ADJACENT_EDGES,
    "edges_in": ADJACENT_EDGES,
    "node_degrees": NODE_DEGREES,
    "kind_counts": KIND_COUNTS,
}

LANGUAGES = ("python", "javascript", "typescript")
SYMBOL_KINDS = ("function", "class", "method")
DEPENDENCY_KINDS = ("imports", "calls", "inherits")
STATUSES = ("resolved", "ambiguous", "unresolved")
NODE_KINDS = ("repository", "file", "symbol")
#: In the order in which statistics list them.
RELATIONSHIP_KINDS = ("contains", "defines", "imports", "calls", "inherits")
