"""Files of a workspace: safe listing, discovery, language, metadata."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import suffix
from ..functions.shaping import percent
from ..scratch import stored

# fixed values: folders and files passed over, bytes sniffed for NUL, and the suffix tables
IGNORED = (".git", "node_modules", "__pycache__", ".venv", "dist", "build")
SNIFFED = 8192
PARSED_SUFFIXES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript"}
COUNTED_SUFFIXES = {
    ".py": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript",
    ".java": "Java", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".c": "C", ".h": "C", ".cpp": "C++",
    ".hpp": "C++", ".cs": "C#", ".sql": "SQL", ".sh": "Shell", ".yml": "YAML", ".yaml": "YAML", ".json": "JSON",
    ".md": "Markdown", ".html": "HTML", ".css": "CSS",
}

ENTRIES = "relative_path string, is_dir boolean, length bigint, error string"
#: Bytes of contents in one batch.
READ_AT_ONCE = 8 << 20
#: Files that a task reads, or builds, and parses.
FILES_A_TASK = 1_000
#: Entries that a task lists before it hands folders on to the next round.
LISTED = 20_000


def entries_of(root: str, folder: str) -> Iterator[tuple[str, bool, int | None, str | None]]:
    """(relative path, is folder, size, error) of what lies in one folder, but for what is ignored; links are passed over."""
    with os.scandir(os.path.join(root, folder) if folder else root) as entries:
        for entry in sorted(entries, key=lambda e: e.name):
            if entry.name in IGNORED or entry.is_symlink():
                continue
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_dir(follow_symlinks=False):
                yield path, True, None, None
                continue
            try:
                yield path, False, entry.stat(follow_symlinks=False).st_size, None
            except OSError as problem:
                yield path, False, None, f"size unknown: {problem}"


def lister(root: str, most: int):
    """mapInArrow body: folders to what lies below them; folders that are left when `most` entries are listed come out as pending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folders, rows, listed = batch.column(0).to_pylist()[::-1], [], 0
            while folders:
                if listed >= most:
                    rows += [(folder, True, None, None, True) for folder in folders]
                    break
                for entry in entries_of(root, folders.pop()):
                    rows.append((*entry, False))
                    listed += 1
                    if entry[1]:
                        folders.append(entry[0])
            for at in range(0, len(rows), 10_000):
                columns = zip(*rows[at : at + 10_000], strict=True)
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["relative_path", "is_dir", "length", "error", "pending"])

    return run


def listing(spark: SparkSession, root: str | Path) -> DataFrame:
    """Names and sizes of everything in a workspace, listed by executors.

    A task lists folders and what lies below them; when it has listed LISTED entries, the folders it
    has left are dealt out anew, so a large tree is spread over tasks round by round.  No path comes
    to the driver."""
    base = str(Path(root).resolve())
    folders, whole = spark.createDataFrame([("",)], "relative_path string"), None
    while True:
        found = stored(folders.mapInArrow(lister(base, LISTED), f"{ENTRIES}, pending boolean"), "listing")
        rows = found.where("not pending").drop("pending")
        whole = rows if whole is None else whole.unionByName(rows)
        folders = found.where("pending").select("relative_path").repartition("relative_path")
        if folders.isEmpty():
            return whole


def contents(root: str, path: str, most: int) -> tuple[bytes | None, str | None]:
    """A file's bytes, or why not: links that took its place are not followed, files that grew beyond `most` are not read."""
    try:
        with open(os.open(os.path.join(root, path), os.O_RDONLY | os.O_NOFOLLOW), "rb") as file:
            read = file.read(most + 1)
    except OSError as problem:
        return None, f"contents unreadable: {problem.strerror}"
    return (read, None) if len(read) <= most else (None, "it grew while it was read")


def reader(root: str, most: int):
    """mapInArrow body over (relative_path, length, error): with content, a few files a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0

            def out() -> pa.RecordBatch:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["relative_path", "length", "error", "content"])

            for path, length, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = None
                if error is None and length is not None and length <= most:
                    content, error = contents(root, path, most)
                rows.append((path, length, error, content))
                held += len(content or b"")
                if held > READ_AT_ONCE:
                    yield out()
                    rows, held = [], 0
            if rows:
                yield out()

    return run


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """One row per file, dealt to tasks of about FILES_A_TASK by their number: what a file costs is not
    seen from the few bytes of its row, by which Spark would join them into one task.

    rows are counted first, so they should be a table as it lies."""
    return rows.repartition(1 + rows.count() // FILES_A_TASK, key)


def language_of(path: Column) -> Column:
    """Language that is parsed, by suffix; null for any other file."""
    return F.create_map(*[F.lit(x) for pair in PARSED_SUFFIXES.items() for x in pair])[suffix(path)]


def is_tsx(path: Column) -> Column:
    return suffix(path) == ".tsx"


def looks_binary(content: Column, marker: bytes = b"\x00") -> Column:
    return F.contains(F.substring(content, 1, SNIFFED), F.lit(marker))


def classified(rows: DataFrame, max_bytes: int) -> DataFrame:
    """rows: relative_path, length, error (of the listing) and content (null if not read).

    Gives relative_path, content, stage and reason: candidates have neither stage nor reason;
    what could not be read has both; what is passed over, too long or binary, has a reason only."""
    unread = F.col("error").isNotNull() | F.col("length").isNull()
    too_long = F.col("length") > max_bytes
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(too_long, F.format_string(f"%d bytes; up to {max_bytes} are parsed", "length"))
        .when(F.col("length").isNull() | F.col("content").isNull(), F.lit("contents unreadable"))
        .when(looks_binary(F.col("content")), F.lit("a NUL byte near the start: no text"))
    )
    stage = F.when(unread | (~too_long & F.col("content").isNull()), F.lit("read"))
    return rows.select("relative_path", F.when(reason.isNull(), F.col("content")).alias("content"), stage.alias("stage"), reason.alias("reason"))


def discovered(spark: SparkSession, root: str | Path, max_bytes: int) -> DataFrame:
    """relative_path, content, stage, reason of every listed file, as classified() gives them.

    Listing and reading are done by executors, which must see the workspace at the same path; files
    that are too long by the listing are never opened, and links are never followed."""
    base = str(Path(root).resolve())
    known = listing(spark, base).where(~F.col("is_dir")).select("relative_path", "length", "error")
    small_batches = dealt(known, "relative_path").mapInArrow(reader(base, max_bytes), "relative_path string, length bigint, error string, content binary")
    return classified(small_batches, max_bytes)


def metadata(entries: DataFrame, has_git: bool, scanned_at: datetime | None = None) -> DataFrame:
    """One row: counts, bytes, language shares over all files, readme and git flags, and the files of each language.

    A share has one decimal, so the number of files cannot be told from it."""
    counted = F.create_map(*[F.lit(x) for pair in COUNTED_SUFFIXES.items() for x in pair])
    name = F.regexp_extract("relative_path", "[^/]*$", 0)
    language = F.when(~F.col("is_dir"), counted[suffix(F.col("relative_path"))])
    readme = ~F.col("is_dir") & F.startswith(F.upper(name), F.lit("README"))
    # first per language (a row for each known one, and one for the rest), then over those few rows
    each = entries.withColumn("language", language).groupBy("language").agg(
        F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("folders"), F.sum("length").alias("bytes"), F.bool_or(readme).alias("readme")
    )
    by_count = F.sort_array(F.collect_list(F.when(F.col("language").isNotNull(), F.struct(F.col("files"), F.col("language")))), asc=False)
    whole = each.agg(
        F.coalesce(F.sum("files"), F.lit(0)).cast("int").alias("file_count"), F.coalesce(F.sum("folders"), F.lit(0)).cast("int").alias("directory_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_size_bytes"), F.coalesce(F.bool_or("readme"), F.lit(False)).alias("has_readme"), by_count.alias("by_count"),
    )
    stats = F.map_from_entries(F.transform("by_count", lambda e: F.struct(e["language"], percent(e["files"], F.col("file_count")))))
    return whole.select(
        "file_count", "directory_count", "total_size_bytes", stats.alias("language_stats"), "has_readme",
        F.lit(has_git).alias("has_git"), F.lit(scanned_at or datetime.now(UTC)).alias("scanned_at"),
        F.map_from_entries(F.transform("by_count", lambda e: F.struct(e["language"], e["files"]))).alias("language_counts"),
    )


def scan(spark: SparkSession, root: str | Path, scanned_at: datetime | None = None) -> DataFrame:
    return metadata(listing(spark, root), (Path(root) / ".git").exists(), scanned_at).drop("language_counts")
