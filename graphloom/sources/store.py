"""Parquet tables of repositories with one commit point for each repository.

A write puts new files beside the old ones, below a version of its own; a commit then says
which version of each table counts.  Readers follow the last commit, so all tables of a save
change together, and a save that fails changes nothing.  Layout below the root:

    <table>/repository_id=<id>/version=<name>/*.parquet
    _commits/<id>/<number>.json     {tables: {table: version}, at: seconds} of the repository
    _intents/<id>/<version>.json    a save at work (commits.Intents)
    _zones/<table>/repository_id=<id>/version=<name>/   first and last key and rows of each file
    _ids/<table>/<number>.json      {segments: [{name, rows}]} of the id index
    _ids/<table>/segment=<name>/    (h, id, repository_id, version), in order of the hash h of id
    <keyed table>/row=<key>/version=<name>/*.parquet    rows with a sequence number; the last wins

Versions that no commit names any more are cleared: those of the two last commits stay, those that
were superseded less than `retention` seconds ago, and those of writers at work.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Conflict
from ..operators import adjacency
from ..operators.paging import after
from ..schemas import TABLES
from .commits import COMMIT, Folder, Intents, Log

KEYED = {"projects": "id", "repositories": "id"}
#: The order in which the rows of a table lie, which is that of its pages.
CLUSTERED = {"symbols": ["start_line", "id"], "dependency_edges": ["start_line", "id"], "graph_nodes": ["id"], "graph_edges": ["source_id", "target_id", "kind", "dependency_edge_id"]}
#: Tables with an index of their ids.
INDEXED = ("symbols", "dependency_edges")
CLUSTERED |= dict.fromkeys(adjacency.SIDES, adjacency.COLUMNS)
#: Segments of the id index of like size that are merged.
MERGED_SEGMENTS = 4
#: Files that the first read of a page opens.
PAGE_FILES = 2


class Store(Folder):
    """Tables below one root.  Readers of a repository read its files alone."""

    def __init__(self, spark: SparkSession, root: str, lease: float = 900.0, retention: float = 3600.0):
        super().__init__(spark, root)
        self.lease, self.retention = lease, retention

    def ensure(self) -> None:
        """Create the folder of every table that is not there yet."""
        for name in [*TABLES, "_commits"]:
            self.make(name)

    # ---- commits ------------------------------------------------------------------

    def _log(self, repository_id: str) -> Log:
        return Log(self, f"_commits/{repository_id}")

    def _intents(self, repository_id: str) -> Intents:
        return Intents(self, f"_intents/{repository_id}", self.lease)

    def versions(self, repository_id: str) -> dict[str, str]:
        """The version of each table that the last commit of a repository names."""
        return self._log(repository_id).last()[1].get("tables", {})

    def _at(self, name: str, repository_id: str, version: str) -> str:
        return f"{name}/repository_id={repository_id}/version={version}"

    def replace_all(self, repository_id: str, tables: dict[str, DataFrame]) -> None:
        """Replace several tables of one repository together: all of them or, on any failure, none.

        Saves of other tables by other writers are kept.  If one of these tables was changed by
        another writer since this save began, or this save was taken for dead, it raises Conflict and
        leaves nothing."""
        number, said = self._log(repository_id).last()
        began = said.get("tables", {})
        version = f"{number + 1:012d}-{uuid.uuid4().hex[:8]}"
        intents = self._intents(repository_id)
        with intents.held(version):
            try:
                for name, rows in tables.items():
                    self._write(name, repository_id, version, rows)
                if not intents.decide(version, COMMIT):
                    raise Conflict(f"the save of repository {repository_id} took longer than its lease and was dropped")

                def committed(last: dict) -> dict:
                    now = last.get("tables", {})
                    if any(now.get(name) != began.get(name) for name in tables):
                        raise Conflict(f"the tables of repository {repository_id} were changed by another writer")
                    return {"tables": now | dict.fromkeys(tables, version), "at": time.time()}

                self._log(repository_id).append(committed)
            except BaseException:
                self._forget(repository_id, version, list(tables))
                raise
        self.clear(repository_id)

    def replace(self, name: str, repository_id: str, rows: DataFrame) -> None:
        """Replace one table of one repository, also when there are no rows left for it."""
        self.replace_all(repository_id, {name: rows})

    def _write(self, name: str, repository_id: str, version: str, rows: DataFrame) -> None:
        schema, place = TABLES[name], self.path(self._at(name, repository_id, version))
        fitted = rows.where(F.col("repository_id") == repository_id).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name != "repository_id"])
        keys = CLUSTERED.get(name)
        if keys is None:
            fitted.write.parquet(place)
            return
        writer = fitted.repartitionByRange(*keys).sortWithinPartitions(*keys).write
        if name in INDEXED:
            writer = writer.option("parquet.bloom.filter.enabled#id", "true")
        writer.parquet(place)
        there = self.spark.read.schema(fitted.schema).parquet(place)
        adjacency.zones_of(there, keys).coalesce(1).write.parquet(self.path(f"_zones/{self._at(name, repository_id, version)}"))
        if name in INDEXED:
            self._index(name, repository_id, version, there)

    def _forget(self, repository_id: str, version: str, tables: list[str]) -> None:
        for name in tables:
            self.delete(self._at(name, repository_id, version))
            self.delete(f"_zones/{self._at(name, repository_id, version)}")

    def clear(self, repository_id: str) -> None:
        """Delete the versions of a repository that no reader and no writer can need.

        What lies there is listed first, then the writers at work are asked, then the commits are
        read: a version whose writer was done by the second step is named by a commit in the third."""
        lying = [(name, v.removeprefix("version=")) for name in TABLES if name not in KEYED for v in self.names(f"{name}/repository_id={repository_id}")]
        intents = self._intents(repository_id)
        at_work = {v for v in {v for _, v in lying} if intents.at_work(v)}
        log, now = self._log(repository_id), time.time()
        entries = [(n, said) for n in log.numbers() if (said := log.read(n)) is not None]
        keep, first = set(), entries[-1][0] if entries else 0
        for i, (number, said) in enumerate(entries):
            superseded = entries[i + 1][1]["at"] if i + 1 < len(entries) else now
            if i + 2 >= len(entries) or now - superseded < self.retention:
                keep |= set(said["tables"].items())
                first = min(first, number)
        for name, version in lying:
            if version not in at_work and (name, version) not in keep:
                self._forget(repository_id, version, [name])
        log.trim(first)

    # ---- reading --------------------------------------------------------------------

    def table(self, name: str, repository_id: str | None = None) -> DataFrame:
        """Committed rows of one repository, or of all."""
        schema = TABLES[name]
        if name in KEYED:
            return self._keyed(name)
        ids = [i for i in self.names("_commits")] if repository_id is None else [repository_id]
        versions = {r: self.versions(r).get(name) for r in ids}  # a small file for each repository
        return self._read(name, [(r, v) for r, v in versions.items() if v])

    def _read(self, name: str, versions: list[tuple[str, str]], files: list[str] | None = None) -> DataFrame:
        schema = TABLES[name]
        if not versions:
            return self.spark.createDataFrame([], schema)
        paths = [self.path(self._at(name, r, v)) for r, v in versions]
        if files is not None:
            paths = [f"{paths[0]}/{f}" for f in files]
        rows = self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(*paths)
        return rows.select(*[F.col(c.name) for c in schema])

    def adjacency(self, repository_id: str) -> adjacency.Adjacency | None:
        """The edges of a repository by both of their ends; None if they were not saved so."""
        versions = self.versions(repository_id)
        if not all(name in versions for name in adjacency.SIDES):
            return None
        sides = []
        for name in adjacency.SIDES:
            at = self._at(name, repository_id, versions[name])
            schema = ", ".join(f"{c} string" for c in adjacency.COLUMNS)
            sides.append(adjacency.Side(self.spark.read.schema(schema).parquet(self.path(at)), self.path(at), self.spark.read.parquet(self.path(f"_zones/{at}"))))
        return adjacency.Adjacency(*sides)

    # ---- pages ------------------------------------------------------------------------

    def page_after(self, name: str, repository_id: str, cursor: tuple | None = None, limit: int = 100, where: Column | None = None) -> DataFrame:
        """The next `limit` rows behind a cursor (the keys of the last row seen; None: from the start), in the order of CLUSTERED.

        Only the files that can hold them are opened: those whose last key lies behind the cursor, in
        order, a few at first and twice as many while rows are missing."""
        keys, version = CLUSTERED[name], self.versions(repository_id).get(name)
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        zones = self.spark.read.parquet(self.path(f"_zones/{self._at(name, repository_id, version)}"))
        high = [F.col(f"high.{k}") for k in keys]
        behind = zones if cursor is None else zones.where(after(high, cursor))
        many = PAGE_FILES
        while True:
            files = [r["file"] for r in behind.orderBy("low", "file").limit(many).select("file").collect()]
            rows = self._read(name, [(repository_id, version)], files) if files else self.spark.createDataFrame([], TABLES[name])
            if cursor is not None:
                rows = rows.where(after([F.col(k) for k in keys], cursor))
            if where is not None:
                rows = rows.where(where)
            page = rows.orderBy(*keys).limit(limit)
            if len(files) < many or page.count() == limit:
                return page
            many *= 2

    # ---- lookups by id ------------------------------------------------------------------

    def _segments(self, name: str) -> list[dict]:
        return Log(self, f"_ids/{name}").last()[1].get("segments", [])

    def _segment_rows(self, name: str, segments: list[dict]) -> DataFrame:
        return self.spark.read.schema("h long, id string, repository_id string, version string").parquet(*[self.path(f"_ids/{name}/segment={s['name']}") for s in segments])

    def _index(self, name: str, repository_id: str, version: str, rows: DataFrame) -> None:
        """Add the ids of a version to the index, before it is committed: lookups ask the last commit anyway."""
        ids = rows.select(F.xxhash64("id").alias("h"), "id", F.lit(repository_id).alias("repository_id"), F.lit(version).alias("version"))
        self._put_segment(name, ids, [])
        segments = self._segments(name)
        first, total = len(segments) - 1, segments[-1]["rows"]
        while first > 0 and segments[first - 1]["rows"] <= 2 * total:
            first -= 1
            total += segments[first]["rows"]
        alike = segments[first:]
        if len(alike) >= MERGED_SEGMENTS:  # each row is merged once for each doubling
            self._put_segment(name, self._segment_rows(name, alike).join(self._outdated(name), ["repository_id", "version"], "left_anti").select("h", "id", "repository_id", "version"), alike)

    def _outdated(self, name: str) -> DataFrame:
        """(repository_id, version) that the index names and a later commit replaced."""
        said = self.spark.read.schema("tables map<string,string>").json(self.path("_commits/*/*.json"))
        place = F.split(F.col("_metadata.file_path"), "/")
        last = said.select(F.element_at(place, -2).alias("repository_id"), F.element_at(place, -1).alias("number"), F.col("tables")[name].alias("now")).groupBy("repository_id").agg(F.max_by("now", "number").alias("now"))
        known = self._segment_rows(name, self._segments(name)).select("repository_id", "version").distinct()
        return known.join(last, "repository_id").where(F.substring("version", 1, 12) < F.substring("now", 1, 12)).select("repository_id", "version")

    def _put_segment(self, name: str, ids: DataFrame, instead: list[dict]) -> None:
        """Write a segment, in ranges of the hash, and name it in place of others."""
        fresh = uuid.uuid4().hex
        place = self.path(f"_ids/{name}/segment={fresh}")
        ids.repartitionByRange("h").sortWithinPartitions("h").write.parquet(place)
        entry = {"name": fresh, "rows": self.spark.read.schema("h long").parquet(place).count()}
        gone = {s["name"] for s in instead}

        def named(last: dict) -> dict:
            have = last.get("segments", [])
            if not gone <= {s["name"] for s in have}:
                return last  # another writer merged them first
            return {"segments": sorted([s for s in have if s["name"] not in gone] + [entry], key=lambda s: -s["rows"])}

        log = Log(self, f"_ids/{name}")
        number, _ = log.append(named)
        log.trim(number - 8)

    def lookup(self, name: str, key: str) -> DataFrame:
        """Committed rows of any repository with this id: a range of the index, then one version of each repository that has it."""
        segments = self._segments(name)
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        entries = self._segment_rows(name, segments).where((F.col("h") == F.xxhash64(F.lit(key))) & (F.col("id") == key)).select("repository_id", "version").distinct()
        found = [(r["repository_id"], r["version"]) for r in entries.collect()]  # versions that hold one id
        current = {r: self.versions(r).get(name) for r, _ in found}
        return self._read(name, [(r, v) for r, v in found if current[r] == v]).where(F.col("id") == key)

    # ---- small keyed tables ---------------------------------------------------------

    def _rows(self, name: str, place: str) -> DataFrame:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES[name])
        return self.spark.read.schema(f"{fields}, sequence string").option("recursiveFileLookup", "true").parquet(place)

    def _keyed(self, name: str) -> DataFrame:
        """The row with the last sequence number of each key."""
        columns = [f.name for f in TABLES[name]]
        if not self.names(name):
            return self.spark.createDataFrame([], TABLES[name])
        latest = Window.partitionBy(KEYED[name]).orderBy(F.desc("sequence"))
        return self._rows(name, self.path(name)).withColumn("place", F.row_number().over(latest)).where("place = 1").select(*columns)

    def upsert(self, name: str, row: dict) -> None:
        """Put one row into a small keyed table, in place of the row with its key.

        The new row is added before old ones go, so a reader always finds one; the two before it stay
        for readers that have listed them."""
        key, schema = KEYED[name], TABLES[name]
        folder = f"{name}/row={row[key]}"
        old = self.names(folder)
        number = max([int(v.removeprefix("version=")[:12]) for v in old], default=0) + 1
        sequence = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        fresh = self.spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema)
        fresh.withColumn("sequence", F.lit(sequence)).coalesce(1).write.parquet(self.path(f"{folder}/version={sequence}"))
        for version in old[:-2]:
            self.delete(f"{folder}/{version}")

    def row(self, name: str, key: str) -> dict | None:
        """One row of a small keyed table."""
        place = f"{name}/row={key}"
        if not self.exists(place):
            return None
        columns = [f.name for f in TABLES[name]]
        found = self._rows(name, self.path(place)).orderBy(F.desc("sequence")).select(*columns).first()
        return found.asDict(recursive=True) if found else None
