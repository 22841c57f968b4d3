"""The service's endpoints over an Engine: the same operations, answers in the shapes that clients see."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edges as edge_ops
from ..operators import graph, listings, summaries
from . import responses
from .service import Engine


def rows_of(frame: DataFrame) -> list[dict]:
    """A page as values; pages are limited before they get here."""
    return [r.asDict(recursive=True) for r in frame.collect()]


def streamed(frame: DataFrame) -> Iterator[dict]:
    """A listing without a limit, never held whole."""
    return (r.asDict(recursive=True) for r in frame.toLocalIterator())


class Api:
    def __init__(self, engine: Engine):
        self.engine = engine

    # ---- parsing ----------------------------------------------------------------------

    def parse(self, repository_id: str) -> dict:
        counts = self.engine.parse(repository_id)
        at = listings.last_parsed_at(self.engine._t("parsed_files", repository_id)).first()["last_parsed_at"]
        return {"repository_id": repository_id, "file_count": counts["files_parsed"], "symbol_count": counts["symbols"], "import_count": counts["imports"], "error_count": counts["errors"], "parsed_at": at}

    def files(self, repository_id: str) -> Iterator[dict]:
        """All files, in order, a partition at a time: a repository may have more than fit here at once."""
        return streamed(responses.files(self.engine.list_files(repository_id), repository_id).orderBy("path", "id"))

    def symbols(self, repository_id: str, kind: str | None = None, file_id: str | None = None, limit: int = 100, offset: int = 0) -> list[dict]:
        page = self.engine.list_symbols(repository_id, kind, file_id, limit, offset)
        whole = listings.children(page, self.engine._t("parameters", repository_id), self.engine._t("call_sites", repository_id))
        return rows_of(responses.symbols(whole).orderBy("start_line", "id"))

    def symbol(self, symbol_id: str) -> dict:
        return rows_of(responses.symbols(self.engine.nested_symbol(symbol_id)).limit(1))[0]

    def parse_errors(self, repository_id: str) -> Iterator[dict]:
        return streamed(self.engine.list_parse_errors(repository_id))

    # ---- dependencies -----------------------------------------------------------------

    def analyze(self, repository_id: str) -> dict:
        counts = self.engine.analyze_dependencies(repository_id)
        named = {f"{k}_count": counts[k] for k in ("resolved", "ambiguous", "unresolved")}
        return {"repository_id": repository_id, "edge_count": counts["total"], **named, "analyzed_at": datetime.now(UTC)}

    def dependencies(self, repository_id: str, **filters) -> list[dict]:
        return rows_of(responses.dependencies(self.engine.list_dependencies(repository_id, **filters)))

    def dependency(self, dependency_id: str) -> dict:
        found = self.engine.get_dependency(dependency_id)
        return {name: found[name] for name in responses.EDGE}

    # ---- graph ------------------------------------------------------------------------

    def project(self, repository_id: str) -> dict:
        counts = self.engine.project_graph(repository_id)
        return {"repository_id": repository_id, "node_count": counts["nodes"], "relationship_count": counts["relationships"], "projected_at": self._projected(repository_id)}

    def _projected(self, repository_id: str):
        return self.engine._t("graph_nodes", repository_id).agg(F.max("projected_at")).first()[0]

    def nodes(self, repository_id: str, kind: str | None = None, limit: int = 100, offset: int = 0) -> list[dict]:
        return rows_of(responses.nodes(self.engine.list_nodes(repository_id, kind, limit, offset)))

    def relationships(self, repository_id: str, kind: str | None = None, limit: int = 100, offset: int = 0) -> list[dict]:
        return rows_of(responses.relationships(self.engine.list_relationships(repository_id, kind, limit, offset)))

    def neighbors(self, repository_id: str, node_id: str, direction: str = "both", kind: str | None = None, limit: int = 100) -> list[dict]:
        nodes, edges = self.engine._with_node(repository_id, node_id)
        return self.engine._limited(lambda: responses.neighbors(graph.neighbors(nodes, edges, node_id, direction, kind, limit), nodes))

    def impact(self, repository_id: str, node_id: str, direction: str = "upstream", depth: int = 3, kind: str | None = None, limit: int = 100) -> dict:
        self.engine._checked(limit, depth, self.engine.settings.max_impact_depth)
        nodes, edges = self.engine._with_node(repository_id, node_id)
        found = self.engine._limited(lambda: responses.impacted(graph.impact(nodes, self.engine._walks(repository_id, edges), node_id, direction, depth, kind, limit), nodes))
        return {"starting_node_id": node_id, "direction": direction, "max_depth": depth, "impacted_nodes": found}

    def path(self, repository_id: str, source_id: str, target_id: str, depth: int = 6, kind: str | None = None) -> dict:
        self.engine._checked(None, depth, self.engine.settings.max_path_depth)
        nodes, edges = self.engine._with_node(repository_id, source_id, target_id)
        return self.engine._limited(lambda: responses.path(graph.shortest_path(nodes, self.engine._walks(repository_id, edges), source_id, target_id, depth, kind), nodes, edges, source_id, target_id))[0]

    def statistics(self, repository_id: str, limit: int = 10) -> dict:
        found = self.engine.statistics(repository_id, limit, responses.degrees)
        by_kind = found["nodes_by_kind"]
        return {
            "repository_id": repository_id, "total_nodes": found["total_nodes"], "total_files": by_kind["file"], "total_symbols": by_kind["symbol"],
            "total_relationships": found["total_relationships"], "relationships_by_kind": [{"kind": k, "count": n} for k, n in found["relationships_by_kind"].items()],
            "highest_in_degree": found["highest_in_degree"], "highest_out_degree": found["highest_out_degree"], "projected_at": found["projected_at"], "freshness": found["freshness"], "computed_at": datetime.now(UTC),
        }

    def insights(self, repository_id: str, limit: int = 20) -> dict:
        self.engine._checked(limit)
        nodes, edges = self.engine._graph(repository_id)
        _, degrees = self.engine._summaries(repository_id)
        ask = self.engine._limited
        return {
            "repository_id": repository_id,
            "most_connected_files": ask(lambda: responses.degrees(summaries.top(degrees, "n_imports", limit, "file"), nodes)),
            "dependency_hotspots": ask(lambda: responses.degrees(summaries.top(degrees, "n_uses", limit, "symbol"), nodes)),
            "isolated_nodes": ask(lambda: summaries.isolated(degrees, limit).select("id").join(responses.node_struct(nodes), "id").select("node.*").orderBy(F.col("kind"), "id")),
            "mutual_import_pairs": ask(lambda: responses.mutual_pairs(graph.mutual_pairs(edges, limit=limit), nodes)),
            "unresolved_dependency_count": ask(lambda: edge_ops.unresolved_count(self.engine._t("dependency_edges", repository_id)))[0]["unresolved_edges"],
            "computed_at": datetime.now(UTC),
        }
