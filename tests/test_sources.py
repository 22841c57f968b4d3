import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.errors import InvalidSource, UnsafeArchive, WorkspaceProblem
from graphloom.settings import Settings
from graphloom.sources import archives, clones, files, workspaces


def packed(tmp_path, entries, mode=None):
    target = tmp_path / "a.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries.items():
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            if mode:
                info.external_attr = mode << 16
            z.writestr(info, body)
    return target


@pytest.mark.parametrize("name", ["../../etc/passwd", "/etc/passwd", "C:/x", "a\\..\\..\\b", " "])
def test_unsafe_names(spark, tmp_path, name):
    with pytest.raises(UnsafeArchive):
        archives.validate(spark, packed(tmp_path, {name: "x"}), Settings())


def test_archive_limits(spark, tmp_path):
    archive = packed(tmp_path, {"a.py": "".join(map(str, range(1500))), "b/c.py": "y"})
    archives.validate(spark, archive, Settings())
    for limit in ({"max_archive_entries": 1}, {"max_archive_entry_bytes": 100}, {"max_archive_bytes": 100}, {"max_archive_ratio": 2}):
        with pytest.raises(UnsafeArchive):
            archives.validate(spark, archive, Settings(**limit))
    with pytest.raises(UnsafeArchive):
        archives.validate(spark, packed(tmp_path, {}), Settings())
    with pytest.raises(UnsafeArchive):
        archives.validate(spark, packed(tmp_path, {"link": "target"}, 0o120777), Settings())
    (tmp_path / "no.zip").write_text("no")
    with pytest.raises(UnsafeArchive):
        archives.validate(spark, tmp_path / "no.zip", Settings())


def test_extraction_stays_inside(tmp_path):
    archives.extract(packed(tmp_path, {"a/b.py": "x"}), tmp_path / "w", Settings())
    assert (tmp_path / "w/a/b.py").read_text() == "x"
    with pytest.raises(UnsafeArchive):
        archives.extract(packed(tmp_path, {"../x": "x"}), tmp_path / "w", Settings())
    with pytest.raises(UnsafeArchive):
        archives.save_upload(io.BytesIO(b"12345"), tmp_path / "up", 4)
    assert not (tmp_path / "up").exists()


@pytest.mark.parametrize(
    "url, fine",
    [("https://host.org/a/b.git", True), ("http://h/a", False), ("git://h/a", False), ("ssh://h/a", False), ("file:///x", False), ("ext::sh -c x", False), ("https://u:p@h/a", False), ("https:///a", False), ("https://h", False), ("https://h/", False), ("https://h_x/a", False)],
)
def test_clone_urls(spark, url, fine):
    if fine:
        clones.validate(spark, url)
    else:
        with pytest.raises(InvalidSource):
            clones.validate(spark, url)


def test_workspaces(tmp_path):
    made = workspaces.create_workspace(tmp_path, "p", "r")
    with pytest.raises(WorkspaceProblem):
        workspaces.create_workspace(tmp_path, "p", "r")
    with pytest.raises(WorkspaceProblem):
        workspaces.delete_workspace(tmp_path / "p", tmp_path.parent)
    workspaces.delete_workspace(tmp_path, made)
    workspaces.delete_workspace(tmp_path, made)
    assert not made.exists()


def workspace(tmp_path):
    for name, body in {"a.py": b"x = 1\n", "b.py": b"", "c.py": b"y", "d.ts": b"z", "README.md": b"hi", "bin.py": b"a\x00b", "big.py": b"#" * 300, ".git/config": b"", "node_modules/m.js": b"", "sub/e.JS": b"//"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "empty").mkdir()
    os.symlink("/etc/passwd", tmp_path / "link.py")
    return tmp_path


def test_discovery(spark, tmp_path):
    found = {r.relative_path: r for r in files.discovered(spark, workspace(tmp_path), 200).collect()}
    assert set(found) == {"a.py", "b.py", "c.py", "d.ts", "README.md", "bin.py", "big.py", "sub/e.JS"}
    assert "NUL" in found["bin.py"].reason and found["big.py"].reason == "300 bytes; up to 200 are parsed" and found["big.py"].stage is None
    assert bytes(found["a.py"].content) == b"x = 1\n" and found["a.py"].reason is None and bytes(found["b.py"].content) == b"" and found["b.py"].reason is None


def test_files_are_dealt_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    """Names are a few bytes each; what is read and parsed behind them is not."""
    from graphloom.plans.driver_sources import found
    from graphloom.plans.driver_tables import Tables

    from .conftest import DATA

    monkeypatch.setattr(files, "FILES_A_TASK", 20)
    for i in range(200):
        (tmp_path / f"f{i}.py").write_text("x = 1")
    for rows, most in ((files.discovered(spark, tmp_path, 99), 200), (found(Tables(spark, str(DATA))), 200)):
        tasks = rows.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
        assert len(tasks) >= 8 and sum(t["count"] for t in tasks) == most


def test_long_files_are_never_read(spark, tmp_path):
    """A file beyond what the scan itself can read is passed over, not a failure of the job."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "250")
    try:
        found = {r.relative_path: r for r in files.discovered(spark, workspace(tmp_path), 200).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert found["big.py"].reason == "300 bytes; up to 200 are parsed" and bytes(found["c.py"].content) == b"y"


def test_files_that_cannot_be_read(spark):
    rows = spark.createDataFrame([("a", 3, None, bytearray(b"abc")), ("b", None, "size unknown: x", None), ("c", 5, None, None), ("d", 900, None, None)], "relative_path string, length long, error string, content binary")
    got = {r.relative_path: (r.stage, r.reason) for r in files.classified(rows, 200).collect()}
    assert got == {"a": (None, None), "b": ("read", "size unknown: x"), "c": ("read", "contents unreadable"), "d": (None, "900 bytes; up to 200 are parsed")}


def test_metadata(spark, tmp_path):
    row = files.scan(spark, workspace(tmp_path)).first()
    assert (row.file_count, row.directory_count, row.has_readme, row.has_git) == (8, 2, True, True)
    assert row.language_stats == {"Python": 62.5, "TypeScript": 12.5, "JavaScript": 12.5, "Markdown": 12.5}


def test_metadata_counts_every_file(spark):
    """A share of one decimal does not tell how many of 9,001 files there are; the counts do."""
    entries = spark.range(9001).selectExpr("concat('f', id, if(id % 3 = 0, '.html', '.txt')) as relative_path", "false as is_dir", "1L as length")
    row = files.metadata(entries, False).first()
    assert row.language_counts == {"HTML": 3001} and row.language_stats == {"HTML": 33.3}


def test_metadata_of_nothing(spark, tmp_path):
    row = files.scan(spark, tmp_path).first()
    assert (row.file_count, row.total_size_bytes, row.language_stats) == (0, 0, {})


def test_languages(spark):
    df = spark.createDataFrame([("a.PY",), ("b.tsx",), (".py",), ("x",)], "p string").select(files.language_of(F.col("p")).alias("l"), files.is_tsx(F.col("p")).alias("t"))
    assert [tuple(r) for r in df.collect()] == [("python", False), ("typescript", True), (None, False), (None, False)]
