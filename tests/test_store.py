"""The store under several writers, slow readers, lost answers; lookups and pages that open few files."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.errors import Conflict
from graphloom.operators.paging import cursor_of, page_after
from graphloom.plans.project import fitted
from graphloom.schemas import DEPENDENCY_EDGES, GRAPH_EDGES, GRAPH_NODES, SYMBOLS
from graphloom.sources.commits import DROP, Folder, Log
from graphloom.sources.store import CLUSTERED, Store


def nodes(spark, n, repository="r"):
    return fitted(spark.range(n).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit("symbol").alias("kind"), F.lit(repository).alias("repository_id")), GRAPH_NODES)


def edges(spark, n, repository="r"):
    return fitted(spark.range(n).select(F.lit("a").alias("source_id"), F.col("id").cast("string").alias("target_id"), F.lit("calls").alias("kind"), F.lit(repository).alias("repository_id")), GRAPH_EDGES)


def symbols(spark, n, repository="r", first=0):
    return fitted(spark.range(first, first + n).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.lit(repository).alias("repository_id"), (F.col("id") % 50).cast("int").alias("start_line"), F.lit("function").alias("kind")), SYMBOLS)


class Slow(Store):
    """A store whose writer waits, after its files are written, for something to happen."""

    meanwhile = None

    def _write(self, *args):
        super()._write(*args)
        if self.meanwhile:
            act, self.meanwhile = self.meanwhile, None
            act()


@pytest.fixture
def stores(spark, tmp_path):
    return Store(spark, str(tmp_path), retention=0), Slow(spark, str(tmp_path), retention=0)


def test_a_save_that_began_meanwhile_keeps_its_files(spark, stores):
    """A commits while B writes another table, clears, saves again and clears; then B commits."""
    a, b = stores
    a.replace("graph_nodes", "r", nodes(spark, 1))

    def twice():
        for n in (2, 3):
            a.replace("graph_nodes", "r", nodes(spark, n))

    b.meanwhile = twice
    b.replace("graph_edges", "r", edges(spark, 5))
    for store in stores:
        assert (store.table("graph_nodes", "r").count(), store.table("graph_edges", "r").count()) == (3, 5)
    a.replace("graph_nodes", "r", nodes(spark, 4))
    assert (a.table("graph_nodes").count(), a.table("graph_edges").count()) == (4, 5)
    assert b.names("_intents/r") == []


def test_the_same_table_by_two_writers(spark, stores):
    """The second to commit gives up and leaves nothing behind; what the first saved stays, also if B's other table is new."""
    a, b = stores
    a.replace("graph_nodes", "r", nodes(spark, 1))
    b.meanwhile = lambda: a.replace("graph_nodes", "r", nodes(spark, 2))
    with pytest.raises(Conflict):
        b.replace_all("r", {"graph_nodes": nodes(spark, 9), "graph_edges": edges(spark, 9)})
    assert a.table("graph_nodes", "r").count() == 2 and a.table("graph_edges", "r").count() == 0
    assert a.names("graph_edges/repository_id=r") == []
    b.replace("graph_nodes", "r", nodes(spark, 9))
    assert a.table("graph_nodes", "r").count() == 9


def test_two_writers_one_inside_the_other(spark, stores):
    """B begins, A begins and ends inside, B ends; then the other way round; two repositories never meet."""
    a, b = stores
    b.meanwhile = lambda: a.replace_all("q", {"graph_nodes": nodes(spark, 2, "q"), "graph_edges": edges(spark, 2, "q")})
    b.replace("graph_nodes", "r", nodes(spark, 1))
    assert {(r.repository_id, r["count"]) for r in a.table("graph_nodes").groupBy("repository_id").count().collect()} == {("r", 1), ("q", 2)}


def test_a_writer_taken_for_dead_cannot_commit(spark, tmp_path, monkeypatch):
    a, b = Store(spark, str(tmp_path), lease=900, retention=0), Slow(spark, str(tmp_path), lease=0.001, retention=0)
    a.replace("graph_nodes", "r", nodes(spark, 1))
    a.replace("graph_nodes", "r", nodes(spark, 2))
    from graphloom.sources import commits

    real = commits.threading.Event.wait
    monkeypatch.setattr(commits.threading.Event, "wait", lambda self, timeout=None: real(self, None) if timeout is not None and timeout < 0.01 else real(self, timeout))  # it never renews

    def later():
        time.sleep(0.05)
        a.replace("graph_nodes", "r", nodes(spark, 3))

    b.meanwhile = later
    with pytest.raises(Conflict, match="lease"):
        b.replace("graph_edges", "r", edges(spark, 5))
    assert a.table("graph_nodes", "r").count() == 3 and a.table("graph_edges", "r").count() == 0
    assert a.names("graph_edges/repository_id=r") == []


def test_a_writer_that_decided_to_commit_is_not_dropped(spark, tmp_path):
    store = Store(spark, str(tmp_path), lease=-1.0)
    intents = store._intents("r")
    store.write("_intents/r/v.json", {"expires": 0})
    assert intents.decide("v", "commit") and not intents.decide("v", DROP) and intents.at_work("v")
    store.write("_intents/r/w.json", {"expires": 0})
    assert not intents.at_work("w") and not intents.decide("w", "commit")


def test_slow_readers_within_the_retention(spark, tmp_path):
    store = Store(spark, str(tmp_path), retention=3600)
    store.replace("graph_nodes", "r", nodes(spark, 1))
    held = store.table("graph_nodes", "r")
    for n in (2, 3, 4, 5):
        store.replace("graph_nodes", "r", nodes(spark, n))
    assert held.count() == 1 and store.table("graph_nodes", "r").count() == 5
    store.retention = 0
    store.clear("r")
    assert len(store.names("graph_nodes/repository_id=r")) == 2 and len(store.names("_zones/graph_nodes/repository_id=r")) == 2


@pytest.mark.parametrize("scheme", ["file", "hdfs", "s3a"])
def test_a_file_is_put_once(spark, tmp_path, scheme):
    """By hard link, by rename without overwriting, by exclusive creation; all on a local folder here."""
    folder = Folder(spark, str(tmp_path))
    folder.make("log")
    folder.scheme = scheme
    assert folder.put_if_absent("log/1.json", {"by": 1}) and not folder.put_if_absent("log/1.json", {"by": 2})
    assert folder.read("log/1.json")["by"] == 1
    assert [n for n in folder.names("log") if not n.endswith(".crc")] == ["1.json"]


@pytest.mark.parametrize("answer", ["lost", "no"])
def test_an_answer_that_got_lost(spark, tmp_path, monkeypatch, answer):
    """The file was put, but the store said it was not, or said nothing."""
    folder = Folder(spark, str(tmp_path))
    real = Folder._claim

    def claim(self, name, said):
        real(self, name, said)
        if answer == "lost":
            raise OSError("connection reset")
        return False

    monkeypatch.setattr(Folder, "_claim", claim)
    assert folder.put_if_absent("log/1.json", {"by": 1}) and not folder.put_if_absent("log/1.json", {"by": 2}) if answer == "no" else folder.put_if_absent("log/1.json", {"by": 1})
    monkeypatch.setattr(Folder, "_claim", lambda self, name, said: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError, match="down"):
        folder.put_if_absent("log/2.json", {"by": 1})


def test_a_log_is_appended_by_all(spark, tmp_path):
    import threading

    folder = Folder(spark, str(tmp_path))
    each = [threading.Thread(target=lambda k=k: [Log(folder, "log").append(lambda last: {"of": last.get("of", []) + [[k, i]]}) for i in range(5)]) for k in range(4)]
    for t in each:
        t.start()
    for t in each:
        t.join()
    assert sorted(Log(folder, "log").last()[1]["of"]) == [[k, i] for k in range(4) for i in range(5)]


# ---- small keyed tables ---------------------------------------------------------------


def test_an_update_is_never_missed(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    row = {"id": "p", "name": "one"}
    store.upsert("projects", row)
    store.upsert("projects", {"id": "q", "name": "other"})
    seen = []
    real = Store.delete
    monkeypatch.setattr(Store, "delete", lambda self, name: (seen.append((self.row("projects", "p")["name"], self.table("projects").count())), real(self, name)))
    listed = store.table("projects")
    for name in ("two", "three", "four", "five"):
        store.upsert("projects", row | {"name": name})
        assert store.row("projects", "p")["name"] == name
    assert seen == [("four", 2), ("five", 2)]
    assert store.names("projects/row=p").__len__() == 3
    assert {r.id: r.name for r in store.table("projects").collect()} == {"p": "five", "q": "other"}
    assert store.row("projects", "nobody") is None and len(listed.columns) == len(store.table("projects").columns)


# ---- lookups ----------------------------------------------------------------------------


def files_of(df):
    return {Path(f).parent.name for f in df.inputFiles()}


def test_lookup_reads_the_index_and_one_version(spark, tmp_path):
    store = Store(spark, str(tmp_path), retention=0)
    for k in range(7):
        store.replace("symbols", f"r{k}", symbols(spark, 20, f"r{k}", 20 * k))
    assert len(store._segments("symbols")) < 7, "segments are merged"
    assert [(r.id, r.repository_id) for r in store.lookup("symbols", "s65").collect()] == [("s65", "r3")]
    assert len(store.lookup("symbols", "s65").inputFiles()) <= 2
    store.replace("symbols", "r3", symbols(spark, 2, "r3", 900))
    assert store.lookup("symbols", "s65").count() == 0 and store.lookup("symbols", "s901").count() == 1
    assert store.lookup("symbols", "nowhere").count() == 0 and store.lookup("dependency_edges", "s1").count() == 0
    assert store._segment_rows("symbols", store._segments("symbols")).count() <= 20 * 7 + 2


def test_merging_drops_what_was_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path), retention=0)
    for k in range(12):
        store.replace("symbols", "r", symbols(spark, 10, "r", k))
    kept = store._segment_rows("symbols", store._segments("symbols")).count()
    assert kept < 12 * 10 and store.lookup("symbols", "s20").count() == 1 and store.lookup("symbols", "s3").count() == 0


# ---- pages ------------------------------------------------------------------------------


def test_pages_by_cursor_give_each_row_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = symbols(spark, 1000).withColumn("start_line", F.when(F.col("start_line") > 3, F.col("start_line")))  # nulls come first
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.replace("symbols", "r", rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys, seen, cursor, opened = CLUSTERED["symbols"], [], None, []
    while True:
        page = store.page_after("symbols", "r", cursor, 90)
        opened.append(len(page.inputFiles()))
        got = page.collect()
        seen += got
        if len(got) < 90:
            break
        cursor = cursor_of(got[-1], keys)
    want = store.table("symbols", "r").orderBy(*keys).collect()
    assert [r.id for r in seen] == [r.id for r in want] and max(opened[:-1]) <= 3
    plain = page_after(rows, keys, cursor_of(want[499], keys), 10).collect()
    assert [r.id for r in plain] == [r.id for r in want[500:510]]


def test_pages_with_a_filter_look_further(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = fitted(spark.range(400).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.lit("r").alias("repository_id"), F.col("id").cast("int").alias("start_line"), F.when(F.col("id") > 390, "calls").otherwise("imports").alias("kind")), DEPENDENCY_EDGES)
    store.replace("dependency_edges", "r", rows)
    first = store.page_after("dependency_edges", "r", None, 5, F.col("kind") == "calls").collect()
    assert [r.id for r in first] == ["e391", "e392", "e393", "e394", "e395"]
    rest = store.page_after("dependency_edges", "r", cursor_of(first[-1], CLUSTERED["dependency_edges"]), 5, F.col("kind") == "calls").collect()
    assert [r.id for r in rest] == ["e396", "e397", "e398", "e399"]
    assert store.page_after("dependency_edges", "nowhere").count() == 0
