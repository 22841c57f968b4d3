"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"
#: The folder of our own of each local application that names none.
_own_roots: dict[str, str] = {}
#: Paths written and not deleted, by application.
_written: dict[str, set[str]] = {}
#: Paths written inside each open temporary() of a thread, innermost last.
_scopes = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a folder of our own, removed at exit, only in local mode."""
    root = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT} to a folder that driver and executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_roots:
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_roots[application] = f"file://{folder}"
    return _own_roots[application]


def scratch(spark: SparkSession, tag: str, outlives: int = 0) -> str:
    """A new path below the shared folder, deleted with the temporary() it is made in.

    outlives: how many of them it outlives, from the innermost."""
    path = f"{scratch_root(spark)}/graphloom/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    open_ = getattr(_scopes, "open", [])
    if len(open_) > outlives:
        open_[-1 - outlives].append(path)
    return path


def stored(df: DataFrame, tag: str, files: int | None = None, outlives: int = 0) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends
    there, and a lost executor costs nothing that was finished before.

    files: most files to write, for tables whose size is known to be small.
    outlives: how many temporary() it outlives, from the innermost."""
    path = scratch(df.sparkSession, tag, outlives)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _written.get(spark.sparkContext.applicationId, set()).discard(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but those that outlive it.

    Only for work that is finished inside: nothing that is read later may depend on them."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        _delete(spark, _scopes.open.pop())


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that were not consumed yet are lost."""
    _delete(spark, list(_written.get(spark.sparkContext.applicationId, ())))
