"""The parse stage: file contents to the relational model, one file at a time on executors."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import PARSE_NAMESPACE, uuid5
from .files import is_tsx, language_of
from .records import FileRecord

#: Time that one file may take.
PARSE_SECONDS = 60.0

PARAMETER = pa.struct([("name", pa.string()), ("annotation", pa.string()), ("default_value", pa.string())])
CALL = pa.struct([("callee", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])
SYMBOL = pa.struct([
    ("kind", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("parent", pa.int32()),
    ("start_line", pa.int32()), ("end_line", pa.int32()), ("start_column", pa.int32()), ("end_column", pa.int32()),
    ("bases", pa.list_(pa.string())), ("parameters", pa.list_(PARAMETER)), ("calls", pa.list_(CALL)),
])
IMPORT = pa.struct([("module", pa.string()), ("names", pa.list_(pa.string())), ("alias", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])
PARSED = pa.schema([
    ("relative_path", pa.string()), ("language", pa.string()), ("has_syntax_errors", pa.bool_()), ("stage", pa.string()), ("failure", pa.string()),
    ("symbols", pa.list_(SYMBOL)), ("imports", pa.list_(IMPORT)),
])
PARSED_DDL = """relative_path string, language string, has_syntax_errors boolean, stage string, failure string,
  symbols array<struct<kind:string,name:string,qualified_name:string,parent:int,start_line:int,end_line:int,start_column:int,end_column:int,bases:array<string>,
    parameters:array<struct<name:string,annotation:string,default_value:string>>,
    calls:array<struct<callee:string,start_line:int,end_line:int>>>>,
  imports array<struct<module:string,names:array<string>,alias:string,start_line:int,end_line:int>>"""


def parser_for(language: str, tsx: bool):
    """The function that turns bytes into a FileRecord.  JSX is part of JavaScript and of TSX, not of plain TypeScript."""
    from .ecmascript_source import parse_ecmascript
    from .python_source import parse_python

    if language == "python":
        return parse_python
    typed = language == "typescript"
    return lambda source: parse_ecmascript(source, typed=typed, jsx=tsx or not typed)


def as_row(path: str, language: str | None, record: FileRecord | None, failure: str | None, stage: str = "parse") -> dict:
    symbols = [
        {
            "kind": s.kind, "name": s.name, "qualified_name": s.qualified_name, "parent": s.parent,
            "start_line": s.span.start_line, "end_line": s.span.end_line, "start_column": s.span.start_column, "end_column": s.span.end_column,
            "bases": s.bases or None,
            "parameters": [{"name": p.name, "annotation": p.annotation, "default_value": p.default} for p in s.parameters],
            "calls": [{"callee": c.callee, "start_line": c.start_line, "end_line": c.end_line} for c in s.calls],
        }
        for s in (record.symbols if record else ())
    ]
    imports = [{"module": i.module, "names": i.names, "alias": i.alias, "start_line": i.start_line, "end_line": i.end_line} for i in (record.imports if record else ())]
    return {"relative_path": path, "language": language, "has_syntax_errors": bool(record and record.has_syntax_errors), "stage": stage, "failure": failure, "symbols": symbols, "imports": imports}


class TooSlow(Exception):
    """A file's time is up."""


@contextmanager
def deadline(seconds: float) -> Iterator[None]:
    """Raise TooSlow inside the block once the time is up; a worker's main thread alone can be stopped so."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_) -> None:
        raise TooSlow(f"not parsed within {seconds:g} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def parse_batches(parser: Callable[[str, bool], Callable[[bytes], FileRecord]], seconds: float):
    """mapInArrow body over (relative_path, language, tsx, content, stage, reason): nested rows, no text in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):  # a file at a time, a few files a batch
                rows = []
                for path, language, tsx, content, stage, reason in zip(*(c.to_pylist() for c in batch.slice(at, 16).columns), strict=True):
                    if stage is not None:
                        rows.append(as_row(path, language, None, reason, stage))
                        continue
                    try:
                        with deadline(seconds):
                            record = parser(language, tsx)(content)
                        rows.append(as_row(path, language, record, None))
                    except Exception as problem:  # one file never stops the others; it becomes a row of parse_errors
                        rows.append(as_row(path, language, None, f"{type(problem).__name__}: {problem}"))
                yield pa.RecordBatch.from_pylist(rows, PARSED)

    return run


def parsed(found: DataFrame, parser: Callable[[str, bool], Callable[[bytes], FileRecord]] = parser_for, seconds: float = PARSE_SECONDS) -> DataFrame:
    """One row per supported candidate of discovered(): its symbols and imports, or its failure; and one
    per file that could not be read, with the stage and the reason.

    A file that takes more than `seconds` fails; those beside it do not."""
    candidates = found.withColumn("language", language_of(F.col("relative_path"))).where("stage is not null or reason is null and language is not null")
    flat = candidates.select("relative_path", "language", is_tsx(F.col("relative_path")).alias("tsx"), "content", "stage", "reason")
    return flat.mapInArrow(parse_batches(parser, seconds), PARSED_DDL)


def relational(repository_id: str, rows: DataFrame, at: datetime | None = None) -> dict[str, DataFrame]:
    """The six tables of one parse, from the stored rows of parsed(), with deterministic identifiers."""
    now, repo = F.lit(at or datetime.now(UTC)), F.lit(repository_id)
    good = rows.where("failure is null").withColumn("file_id", uuid5(PARSE_NAMESPACE, repo, F.col("relative_path")))
    files = good.select(F.col("file_id").alias("id"), repo.alias("repository_id"), F.col("relative_path").alias("path"), "language", "has_syntax_errors", now.alias("parsed_at"))

    def symbol_id(path, s):
        return uuid5(PARSE_NAMESPACE, repo, path, s["qualified_name"], s["kind"], s["start_line"], s["start_column"])

    numbered = good.select("file_id", "relative_path", "symbols", F.posexplode("symbols").alias("at", "s"))
    owner = F.get("symbols", F.col("s.parent"))
    flat = numbered.select(
        symbol_id(F.col("relative_path"), F.col("s")).alias("id"), "file_id", repo.alias("repository_id"),
        F.when(F.col("s.parent").isNotNull(), symbol_id(F.col("relative_path"), owner)).alias("parent_symbol_id"),
        "s.kind", "s.name", "s.qualified_name", "s.start_line", "s.end_line", "s.start_column", "s.end_column",
        F.col("s.bases").alias("base_class_names"), "s.parameters", "s.calls",
    )
    parameters = flat.select(F.col("id").alias("symbol_id"), F.posexplode("parameters").alias("position", "p")).select(
        uuid5(PARSE_NAMESPACE, F.col("symbol_id"), F.lit("parameter"), F.col("position")).alias("id"), "symbol_id", "p.name", F.col("position").cast("int").alias("position"), "p.annotation", "p.default_value", repo.alias("repository_id")
    )
    calls = flat.select(F.col("id").alias("symbol_id"), F.posexplode("calls").alias("ordinal", "c")).select(
        uuid5(PARSE_NAMESPACE, F.col("symbol_id"), F.lit("call"), F.col("ordinal")).alias("id"), "symbol_id", F.col("c.callee").alias("callee_expression"), "c.start_line", "c.end_line", F.col("ordinal").cast("int").alias("ordinal"), repo.alias("repository_id")
    )
    imports = good.select("file_id", "relative_path", F.explode("imports").alias("i")).select(
        uuid5(PARSE_NAMESPACE, repo, F.col("relative_path"), F.col("i.module"), F.col("i.start_line")).alias("id"), "file_id", repo.alias("repository_id"),
        "i.module", F.col("i.names").alias("imported_names"), "i.alias", "i.start_line", "i.end_line",
    )
    failed = rows.where("failure is not null").select("relative_path", "stage", F.col("failure").alias("message"))
    errors = failed.select(
        uuid5(PARSE_NAMESPACE, repo, F.col("relative_path"), F.col("stage"), F.lit("error")).alias("id"), repo.alias("repository_id"), F.col("relative_path").alias("file_path"), "stage", "message", now.alias("occurred_at")
    )
    return {"parsed_files": files, "symbols": flat.drop("parameters", "calls"), "parameters": parameters, "call_sites": calls, "imports": imports, "parse_errors": errors}
