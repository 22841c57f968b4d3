"""The engine's public functions, one for each operation of the service."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, Invalid, Malformed, NotFound, QueryTimeout, WrongState
from ..functions.shaping import stem
from ..operators import edges as edge_ops
from ..operators import graph, listings, summaries
from ..operators.adjacency import Adjacency
from ..operators.paging import cursor_of
from ..schemas import NODE_KINDS, RELATIONSHIP_KINDS
from ..settings import Settings
from ..sources import archives, clones, files, parsing, workspaces
from ..sources.store import CLUSTERED, Store
from ..scratch import stored, temporary
from .project import attached, graph_edges, graph_nodes, graph_tables, merged_nodes


@contextmanager
def time_limit(spark: SparkSession, seconds: float):
    """Cancel the jobs started inside once the time is up, and raise QueryTimeout.

    Cancelling is repeated until the block is left, so jobs that start later end as well; it is
    also raised if the time ran out between two jobs, or after the last."""
    group, expired, left = f"limited-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    context = spark.sparkContext
    context.setJobGroup(group, "time limit", interruptOnCancel=True)

    def watch() -> None:
        if left.wait(seconds):
            return
        expired.set()
        while not left.wait(0.1):
            context.cancelJobGroup(group)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as problem:
        if expired.is_set():
            raise QueryTimeout(f"query exceeded {seconds:g} s") from problem
        raise
    else:
        if expired.is_set():
            raise QueryTimeout(f"query exceeded {seconds:g} s")
    finally:
        left.set()
        watcher.join()
        context.setLocalProperty("spark.jobGroup.id", None)


class Engine:
    """All operations over one store of tables.  Listings return DataFrames."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.store = Store(spark, self.settings.table_root)

    # ---- health, projects, repositories -------------------------------------------

    def health(self) -> dict:
        return {"status": "ok"}

    def graph_available(self) -> bool:
        """There is no remote graph store that could be down."""
        return True

    def create_project(self, name: str, description: str | None = None) -> dict:
        if not 1 <= len(name or "") <= 200:
            raise Malformed("a project name has 1 to 200 characters")
        if description is not None and len(description) > 2000:
            raise Malformed("a project description has at most 2000 characters")
        now = datetime.now(UTC)
        row = {"id": str(uuid.uuid4()), "name": name, "description": description, "status": "active", "created_at": now, "updated_at": now}
        self.store.upsert("projects", row)
        return row

    def get_project(self, project_id: str) -> dict:
        return self._row("projects", project_id, "Project")

    def get_repository(self, repository_id: str) -> dict:
        return self._row("repositories", repository_id, "Repository")

    def _row(self, table: str, key: str, label: str) -> dict:
        row = self.store.row(table, key)
        if row is None:
            raise NotFound(f"{label} {key} not found")
        return row

    def import_zip(self, project_id: str, archive: str | Path, display_name: str | None = None) -> dict:
        limits = self.settings
        return self._import(
            project_id, "zip", str(archive), display_name or self._stem(Path(archive).name),
            lambda: archives.validate(self.spark, archive, limits), lambda workspace: archives.extract(archive, workspace, limits),
        )

    def upload_zip(self, project_id: str, name: str, stream: BinaryIO, display_name: str | None = None) -> dict:
        """import_zip() of an uploaded file, copied to disk in chunks up to max_upload_bytes."""
        with tempfile.TemporaryDirectory(prefix="graphloom-upload-") as folder:
            archive = Path(folder) / "upload.zip"
            archives.save_upload(stream, archive, self.settings.max_upload_bytes)
            return self.import_zip(project_id, archive, display_name or self._stem(name))

    def import_git(self, project_id: str, url: str) -> dict:
        limits = self.settings

        def fetch(workspace: Path) -> None:
            workspace.rmdir()  # clone makes the folder itself
            clones.clone(url, workspace, limits)

        return self._import(project_id, "git", url, self._stem(url), lambda: clones.validate(self.spark, url), fetch)

    def _stem(self, name: str) -> str:
        return self.spark.createDataFrame([(name,)], "n string").select(stem(F.col("n"))).first()[0] or "repository"

    def _import(self, project_id: str, kind: str, ref: str, name: str, validate: Callable[[], None], fetch: Callable[[Path], None]) -> dict:
        """Validate before anything is written; importing, then ready, or failed with the workspace removed."""
        self.get_project(project_id)
        validate()
        now = datetime.now(UTC)
        row = {"id": str(uuid.uuid4()), "project_id": project_id, "source_type": kind, "source_ref": ref, "display_name": name, "status": "pending", "created_at": now, "updated_at": now}
        workspace = workspaces.create_workspace(self.settings.workspace_root, project_id, row["id"])
        row |= {"workspace_path": str(workspace), "status": "importing"}
        self.store.upsert("repositories", row)
        try:
            fetch(workspace)
            with temporary(self.spark):
                facts = files.scan(self.spark, workspace).first().asDict(recursive=True)
            row |= {f"meta_{k}": v for k, v in facts.items()} | {"status": "ready"}
        except Exception as problem:
            workspaces.delete_workspace(self.settings.workspace_root, workspace)
            self.store.upsert("repositories", row | {"status": "failed", "error_message": str(problem), "updated_at": datetime.now(UTC)})
            raise
        row["updated_at"] = datetime.now(UTC)
        self.store.upsert("repositories", row)
        return row

    # ---- parsing ------------------------------------------------------------------

    def _ready(self, repository_id: str) -> dict:
        row = self.get_repository(repository_id)
        if row["status"] != "ready":
            raise WrongState(f"Repository {repository_id} is {row['status']!r}, not ready")
        return row

    def _t(self, name: str, repository_id: str) -> DataFrame:
        return self.store.table(name, repository_id)

    def parse(self, repository_id: str) -> dict:
        """Parse a ready repository's workspace and replace its six tables."""
        row = self._ready(repository_id)
        with temporary(self.spark):
            found = files.discovered(self.spark, row["workspace_path"], self.settings.max_source_bytes)
            rows = stored(parsing.parsed(found, seconds=self.settings.parse_seconds), "parsed")
            self.store.replace_all(repository_id, parsing.relational(repository_id, rows))
        t = lambda name: self._t(name, repository_id)
        return listings.parse_summary(t("parsed_files"), t("parse_errors"), t("symbols"), t("imports")).first().asDict()

    def load_files(self, repository_id: str) -> DataFrame:
        """All files of a repository with everything parsed from them, nested."""
        self.get_repository(repository_id)
        return listings.assembled_files(*[self._t(n, repository_id) for n in ("parsed_files", "symbols", "imports", "parameters", "call_sites")])

    def list_files(self, repository_id: str) -> DataFrame:
        self.get_repository(repository_id)
        return listings.file_summaries(*[self._t(n, repository_id) for n in ("parsed_files", "symbols", "imports")])

    def list_symbols(self, repository_id: str, kind: str | None = None, file_id: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        self.get_repository(repository_id)
        return listings.symbols_page(self._t("symbols", repository_id), repository_id, kind, file_id, limit, offset)

    def get_symbol(self, symbol_id: str) -> dict:
        return self.nested_symbol(symbol_id).first().asDict(recursive=True)

    def nested_symbol(self, symbol_id: str) -> DataFrame:
        """One row: a symbol with its parameters and calls, looked up by the id index."""
        one = self.store.lookup("symbols", symbol_id)
        row = one.first()
        if row is None:
            raise NotFound(f"Symbol {symbol_id} not found")
        return listings.children(one.limit(1), *[self._t(n, row["repository_id"]) for n in ("parameters", "call_sites")])

    def list_parse_errors(self, repository_id: str) -> DataFrame:
        self.get_repository(repository_id)
        return listings.parse_errors(self._t("parse_errors", repository_id), repository_id)

    # ---- dependencies ---------------------------------------------------------------

    def _parsed(self, repository_id: str) -> None:
        self._ready(repository_id)
        if self._t("parsed_files", repository_id).isEmpty():
            raise WrongState(f"Repository {repository_id} has not been parsed yet")

    def analyze_dependencies(self, repository_id: str) -> dict:
        self._parsed(repository_id)
        with temporary(self.spark):
            found = edge_ops.dependency_edges(*[self._t(n, repository_id) for n in ("parsed_files", "symbols", "call_sites", "imports")])
            self.store.replace("dependency_edges", repository_id, found)
        return edge_ops.status_counts(self._t("dependency_edges", repository_id)).first().asDict()

    def list_dependencies(self, repository_id: str, kind: str | None = None, source_symbol_id: str | None = None, target_symbol_id: str | None = None, resolution_status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        self.get_repository(repository_id)
        return listings.edges_page(self._t("dependency_edges", repository_id), repository_id, kind, source_symbol_id, target_symbol_id, resolution_status, limit, offset)

    def get_dependency(self, dependency_id: str) -> dict:
        found = self.store.lookup("dependency_edges", dependency_id).first()
        if found is None:
            raise NotFound(f"Dependency edge {dependency_id} not found")
        return found.asDict()

    # ---- graph ----------------------------------------------------------------------

    def project_graph(self, repository_id: str) -> dict:
        """Rewrite a repository's graph; returns node and relationship counts before merging."""
        self._parsed(repository_id)
        repository = self.store.table("repositories").where(F.col("id") == repository_id)
        parsed, symbols, found = (self._t(n, repository_id) for n in ("parsed_files", "symbols", "dependency_edges"))
        nodes = graph_nodes(repository, parsed, symbols, datetime.now(UTC))
        edges = graph_edges(parsed, symbols, found)
        counts = {"nodes": nodes.count(), "relationships": edges.count()}
        with temporary(self.spark):
            merged, joined = stored(merged_nodes(nodes), "nodes"), stored(attached(nodes, edges), "edges")
            self.store.replace_all(repository_id, graph_tables(repository_id, merged, joined))
        return counts

    def list_nodes(self, repository_id: str, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        self.get_repository(repository_id)
        return listings.nodes_page(self._t("graph_nodes", repository_id), repository_id, kind, limit, offset)

    def list_relationships(self, repository_id: str, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        self.get_repository(repository_id)
        return listings.relationships_page(self._t("graph_edges", repository_id), repository_id, kind, limit, offset)

    def _graph(self, repository_id: str) -> tuple[DataFrame, DataFrame]:
        self.get_repository(repository_id)
        return self._t("graph_nodes", repository_id), self._t("graph_edges", repository_id)

    def page_after(self, name: str, repository_id: str, cursor: tuple | None = None, limit: int = 100, where: Column | None = None) -> tuple[list[dict], tuple | None]:
        """A page of symbols, dependency_edges, graph_nodes or graph_edges behind a cursor, and the cursor behind it; None at the end."""
        self._checked(limit)
        self.get_repository(repository_id)
        rows = [r.asDict(recursive=True) for r in self.store.page_after(name, repository_id, cursor, limit, where).collect()]
        return rows, cursor_of(rows[-1], CLUSTERED[name]) if len(rows) == limit else None

    def _walks(self, repository_id: str, edges: DataFrame) -> DataFrame | Adjacency:
        """The edges by both ends; as they lie for graphs saved without."""
        return self.store.adjacency(repository_id) or edges

    def _checked(self, limit: int | None = None, depth: int | None = None, most: int | None = None) -> None:
        for name, value, ceiling in (("limit", limit, self.settings.max_limit), ("depth", depth, most)):
            if value is not None and value < 1:
                raise Malformed(f"{name} must be 1 or more")
            if value is not None and value > ceiling:
                raise Invalid(f"{name} may be {ceiling} at most")

    def _with_node(self, repository_id: str, *ids: str) -> tuple[DataFrame, DataFrame]:
        nodes, edges = self._graph(repository_id)
        if not graph.endpoints_exist(nodes, list(ids)).first()["all_found"]:
            raise NotFound(f"Graph node {' or '.join(ids)} not found")
        return nodes, edges

    def _limited(self, make: Callable[[], DataFrame]) -> list[dict]:
        with time_limit(self.spark, self.settings.query_timeout_seconds):
            return [r.asDict(recursive=True) for r in make().collect()]  # at most max_limit rows

    def neighbors(self, repository_id: str, node_id: str, direction: str = "both", kind: str | None = None, limit: int = 100) -> list[dict]:
        nodes, edges = self._with_node(repository_id, node_id)
        return self._limited(lambda: graph.neighbors(nodes, edges, node_id, direction, kind, limit))

    def dependencies(self, repository_id: str, node_id: str, kind: str | None = None, limit: int = 100) -> list[dict]:
        self._checked(limit)
        return self.neighbors(repository_id, node_id, "outgoing", kind, limit)

    def dependents(self, repository_id: str, node_id: str, kind: str | None = None, limit: int = 100) -> list[dict]:
        self._checked(limit)
        return self.neighbors(repository_id, node_id, "incoming", kind, limit)

    def impact(self, repository_id: str, node_id: str, direction: str = "upstream", depth: int = 3, kind: str | None = None, limit: int = 100) -> list[dict]:
        self._checked(limit, depth, self.settings.max_impact_depth)
        nodes, edges = self._with_node(repository_id, node_id)
        return self._limited(lambda: graph.impact(nodes, self._walks(repository_id, edges), node_id, direction, depth, kind, limit))

    def path(self, repository_id: str, source_id: str, target_id: str, depth: int = 6, kind: str | None = None) -> dict:
        self._checked(None, depth, self.settings.max_path_depth)
        nodes, edges = self._with_node(repository_id, source_id, target_id)
        return self._limited(lambda: graph.shortest_path(nodes, self._walks(repository_id, edges), source_id, target_id, depth, kind))[0]

    def statistics(self, repository_id: str, limit: int = 10, shown: Callable[[DataFrame, DataFrame], DataFrame] = lambda ranked, nodes: ranked) -> dict:
        """Totals and the nodes of highest degree.  shown: the form of a ranking, made from it and the nodes."""
        self._checked(limit)
        nodes, edges = self._graph(repository_id)
        parsed = self._t("parsed_files", repository_id).select(F.lit(None).cast("timestamp").alias("p"), F.col("parsed_at").alias("q"))
        times = nodes.where("kind = 'repository'").select(F.col("projected_at").alias("p"), F.lit(None).cast("timestamp").alias("q")).unionByName(parsed)
        latest = times.agg(F.max("p").alias("projected_at"), F.max("q").alias("last_parsed_at"))
        state = latest.withColumn("freshness", graph.freshness(F.col("projected_at"), F.col("last_parsed_at")))
        counts, degrees = self._summaries(repository_id)
        counted = {(r["counted"], r["kind"]): r["n"] for r in self._limited(lambda: counts)}
        by_node, by_edge = {k: counted[("node", k)] for k in NODE_KINDS}, {k: counted[("relationship", k)] for k in RELATIONSHIP_KINDS}
        return {
            "total_nodes": sum(by_node.values()), "nodes_by_kind": by_node, "total_relationships": sum(by_edge.values()), "relationships_by_kind": by_edge,
            "highest_in_degree": self._limited(lambda: shown(summaries.top(degrees, "n_in", limit), nodes)), "highest_out_degree": self._limited(lambda: shown(summaries.top(degrees, "n_out", limit), nodes)),
            **self._limited(lambda: state)[0],
        }

    def _summaries(self, repository_id: str) -> tuple[DataFrame, DataFrame]:
        """Kind counts and degrees as saved with the graph; counted anew for graphs saved without."""
        nodes, edges = self._graph(repository_id)
        if "kind_counts" in self.store.versions(repository_id):
            return self._t("kind_counts", repository_id).drop("repository_id"), self._t("node_degrees", repository_id)
        return summaries.kind_counts(nodes, edges), summaries.node_degrees(nodes, edges)

    def insights(self, repository_id: str, limit: int = 20) -> dict:
        self._checked(limit)
        _, edges = self._graph(repository_id)
        _, degrees = self._summaries(repository_id)
        return {
            "most_connected_files": self._limited(lambda: summaries.top(degrees, "n_imports", limit, "file")),
            "dependency_hotspots": self._limited(lambda: summaries.top(degrees, "n_uses", limit, "symbol")),
            "isolated_nodes": self._limited(lambda: summaries.isolated(degrees, limit)),
            "mutual_imports": self._limited(lambda: graph.mutual_pairs(edges, limit=limit)),
            **self._limited(lambda: edge_ops.unresolved_count(self._t("dependency_edges", repository_id)))[0],
        }


def status_of(problem: Exception) -> int:
    """Status code of an error at a service edge."""
    return problem.status if isinstance(problem, EngineError) else 500
