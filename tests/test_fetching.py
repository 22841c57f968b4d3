"""Clones with a stand-in for git, listings by executors, files that take too long to parse."""

import os
import time

import pytest
from pyspark.sql import functions as F

from graphloom.errors import ImportFailed, InvalidSource
from graphloom.settings import Settings
from graphloom.sources import clones, files, parsing
from graphloom.sources.records import FileRecord


@pytest.fixture
def git(tmp_path, monkeypatch):
    """Puts a script named git first on PATH; $TARGET is the folder that it is asked to make."""

    def stand_in(body):
        folder = tmp_path / "bin"
        folder.mkdir(exist_ok=True)
        script = folder / "git"
        script.write_text(f'#!/bin/sh\necho "$@" > {tmp_path}/asked\nfor TARGET; do :; done\n{body}\n')
        script.chmod(0o755)
        monkeypatch.setenv("PATH", f"{folder}:{os.environ['PATH']}")
        return tmp_path / "asked"

    return stand_in


URL = "https://host.example/a/b"


def test_a_clone_is_shallow_and_asks_nothing(git, tmp_path):
    asked = git('mkdir "$TARGET"; echo x > "$TARGET/f.py"; test "$GIT_TERMINAL_PROMPT" = 0')
    clones.clone(URL, tmp_path / "work", Settings())
    assert (tmp_path / "work" / "f.py").read_text() == "x\n"
    assert asked.read_text().split() == ["clone", "--depth=1", "--single-branch", "--", URL, str(tmp_path / "work")]


def test_a_clone_that_fails_says_why_and_leaves_nothing(git, tmp_path):
    git('mkdir "$TARGET"; echo x > "$TARGET/f"; echo "no such repository" >&2; exit 128')
    with pytest.raises(ImportFailed, match="no such repository"):
        clones.clone(URL, tmp_path / "work", Settings())
    assert not (tmp_path / "work").exists()


def test_a_clone_that_takes_too_long_is_killed_with_its_children(git, tmp_path):
    git(f'mkdir "$TARGET"; sh -c "echo \\$\\$ > {tmp_path}/child; exec sleep 60" & wait')
    began = time.time()
    with pytest.raises(ImportFailed, match="stopped after 1"):
        clones.clone(URL, tmp_path / "work", Settings(clone_timeout_seconds=1))
    assert time.time() - began < 10 and not (tmp_path / "work").exists()
    child = int((tmp_path / "child").read_text())
    for _ in range(50):
        try:
            os.kill(child, 0)
        except ProcessLookupError:
            return
        if open(f"/proc/{child}/stat").read().split()[2] == "Z":
            return
        time.sleep(0.1)
    raise AssertionError("a child of git still runs")


def test_a_clone_over_the_size_cap_is_removed(git, tmp_path):
    git('mkdir "$TARGET"; head -c 2000 /dev/zero > "$TARGET/big"; head -c 500 /dev/zero > "$TARGET/small"; chmod 400 "$TARGET/small"')
    with pytest.raises(ImportFailed, match="2500 bytes; 2499"):
        clones.clone(URL, tmp_path / "work", Settings(max_clone_bytes=2499))
    assert not (tmp_path / "work").exists()
    clones.clone(URL, tmp_path / "work", Settings(max_clone_bytes=2500))


def test_no_git_at_all(tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", str(tmp_path))
    with pytest.raises(ImportFailed, match="could not be run"):
        clones.clone(URL, tmp_path / "work", Settings())


def test_an_import_by_clone(spark, git, tmp_path):
    from graphloom.plans.service import Engine

    git('mkdir "$TARGET"; echo "def f(): pass" > "$TARGET/f.py"')
    engine = Engine(spark, Settings(workspace_root=str(tmp_path / "ws"), table_root=str(tmp_path / "tables")))
    project = engine.create_project("p")["id"]
    row = engine.import_git(project, URL)
    assert row["status"] == "ready" and row["meta_file_count"] == 1 and engine.parse(row["id"])["symbols"] == 1
    with pytest.raises(InvalidSource):
        engine.import_git(project, "http://host.example/a/b")
    git("echo broken >&2; exit 1")
    with pytest.raises(ImportFailed, match="broken"):
        engine.import_git(project, URL)
    states = {r.status for r in engine.store.table("repositories").collect()}
    assert states == {"ready", "failed"}


# ---- listings ---------------------------------------------------------------------------


@pytest.fixture
def workspace(tmp_path):
    for path in ("a/b/c/d.py", "a/x.py", "top.js", "node_modules/no.js", ".git/no", "e/long.txt", "e/empty.py"):
        (tmp_path / "w" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / path).write_bytes(b"" if "empty" in path else b"x" * (50 if "long" in path else 3))
    (tmp_path / "w" / "link").symlink_to(tmp_path / "w" / "a")
    (tmp_path / "w" / "a" / "loop.py").symlink_to(tmp_path / "w" / "top.js")
    return tmp_path / "w"


@pytest.mark.parametrize("budget", [1, 3, 10_000])
def test_folders_are_listed_by_executors_round_by_round(spark, workspace, monkeypatch, budget):
    monkeypatch.setattr(files, "LISTED", budget)
    rows = {(r.relative_path, r.is_dir, r.length, r.error) for r in files.listing(spark, workspace).collect()}
    want = {("a", True), ("a/b", True), ("a/b/c", True), ("e", True), ("a/b/c/d.py", False), ("a/x.py", False), ("top.js", False), ("e/long.txt", False), ("e/empty.py", False)}
    assert {(p, d) for p, d, _, _ in rows} == want and len(rows) == len(want)
    found = {r.relative_path: (bytes(r.content) if r.content is not None else None, r.reason) for r in files.discovered(spark, workspace, 10).collect()}
    assert found["a/b/c/d.py"] == (b"xxx", None) and found["e/empty.py"] == (b"", None) and found["e/long.txt"] == (None, "50 bytes; up to 10 are parsed") and "a/loop.py" not in found


def test_an_empty_workspace(spark, tmp_path):
    assert files.listing(spark, tmp_path).count() == 0 and files.discovered(spark, tmp_path, 10).count() == 0
    assert files.scan(spark, tmp_path).first().file_count == 0


def test_a_file_swapped_for_a_link_is_not_read(tmp_path):
    secret = tmp_path / "secret"
    secret.write_bytes(b"secret")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "f").symlink_to(secret)
    assert files.contents(str(tmp_path / "w"), "f", 10)[0] is None
    (tmp_path / "w" / "g").write_bytes(b"grown since it was listed")
    assert files.contents(str(tmp_path / "w"), "g", 10)[0] is None and files.contents(str(tmp_path / "w"), "gone", 10)[0] is None


# ---- deadlines ------------------------------------------------------------------------


def endless(language, tsx):
    def parse(source):
        while source.startswith(b"never"):
            pass
        return FileRecord(has_syntax_errors=False)

    return parse


def test_a_file_that_never_ends_becomes_an_error(spark):
    rows = [(f"f{i}.py", b"never" if i == 3 else b"x = 1", None, None) for i in range(9)]
    found = spark.createDataFrame(rows, "relative_path string, content binary, stage string, reason string")
    parsed = parsing.parsed(found, parser=endless, seconds=0.5).persist()
    failed = {r.relative_path: r.failure for r in parsed.where("failure is not null").collect()}
    assert parsed.count() == 9 and list(failed) == ["f3.py"] and "0.5 s" in failed["f3.py"]
    errors = parsing.relational("r", parsed)["parse_errors"].collect()
    assert [(e.file_path, e.stage) for e in errors] == [("f3.py", "parse")]
    parsed.unpersist()


# ---- hot names -------------------------------------------------------------------------


def test_hot_keys_are_dealt_out_and_nothing_is_lost(spark):
    from graphloom.operators.skew import dealt_join, maybe_present

    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), F.col("id").cast("string").alias("f"))
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("k9", 4), ("none", 5)], "k string, v int")
    want = sorted(map(tuple, rows.join(lookup, "k").select("k", "f", "v").collect()))
    for hot_rows in (0, 100, 10**9):
        assert sorted(map(tuple, dealt_join(rows, lookup, ["k"], "f", hot_rows).select("k", "f", "v").collect())) == want
    kept = maybe_present(rows, ["k"], lookup)
    assert kept.columns == rows.columns and sorted(map(tuple, kept.join(lookup, "k").select("k", "f", "v").collect())) == want
    assert kept.count() < 1600 and maybe_present(rows, ["k"], lookup.limit(0)).count() == 0
