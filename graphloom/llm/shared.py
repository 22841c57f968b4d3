"""What the operators share: scratch tables, Arrow helpers, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import scratch, stored, temporary

__all__ = ["CHUNK_BYTES", "ID", "TEXT", "attach", "crc_bucket", "files_for", "id_text", "scratch", "slices", "small_arrow_batches", "stored", "temporary", "text_buffers"]

ID, TEXT = "__id", "__text"
#: Text handled at once inside a Python worker, so that memory is bounded.
CHUNK_BYTES = 2 << 20
#: Short rows in a file of a stored table.
FILE_ROWS = 100_000


def id_text(docs: DataFrame, id_col: str, text_col: str, null_as: str | None = "") -> DataFrame:
    """Only the two columns, under internal names; null texts become null_as."""
    text: Column = F.col(text_col).cast("string")
    if null_as is not None:
        text = F.coalesce(text, F.lit(null_as))
    return docs.select(F.col(id_col).alias(ID), text.alias(TEXT))


def small_arrow_batches(spark: SparkSession) -> None:
    """Batches sent to Python are bounded in bytes, not only in rows.

    These settings hold for the session from then on, since plans are made when results are
    read; a value that the session has been given before stays."""
    given = spark.conf.getAll
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1024"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))):
        if key not in given:
            spark.conf.set(key, value)


def slices(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, text_at: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows dealt anew, in order: each slice holds at most `limit` bytes of text, or one row."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_buffers(batch.column(text_at))
        at = 0
        while at < batch.num_rows:
            to = min(int(np.searchsorted(ends, ends[at] + limit - held, side="right")) - 1, batch.num_rows)
            if to <= at and not waiting:
                to = at + 1
            if to > at:
                waiting.append(batch.slice(at, to - at))
                held += int(ends[to] - ends[at])
                at = to
            if at < batch.num_rows or held >= limit:
                yield pa.concat_batches(waiting) if len(waiting) > 1 else waiting[0]
                waiting, held = [], 0
    if waiting:
        yield pa.concat_batches(waiting) if len(waiting) > 1 else waiting[0]


def text_buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, and its n + 1 offsets into them (nulls are empty)."""
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def attach(docs: DataFrame, text_col: str, fields: list[T.StructField], measure: Callable[[], Callable[[pa.Array], list[pa.Array]]], limit: int = CHUNK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """docs with new columns computed from the text column in Arrow batches, without a shuffle.

    measure() runs once in each worker and gives a function from a string array to the
    new columns.  A column of docs that has the name of a new one is replaced.
    keep: the columns of docs that come back; texts that nobody asks for stay in the worker."""
    small_arrow_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    docs = docs.select(*[F.col(c) for c in docs.columns if c in keep or c == text_col])
    names = docs.columns
    back = [i for i, c in enumerate(names) if c in keep]
    inner = [f"c{i}" for i in range(len(names))]
    text_at = names.index(text_col)
    new = [f.name for f in fields]
    types = [docs.schema[i].dataType for i in range(len(names))]
    types[text_at] = T.StringType()
    renamed = docs.toDF(*inner).withColumn(inner[text_at], F.col(inner[text_at]).cast("string"))
    schema = T.StructType([T.StructField(inner[i], types[i]) for i in back] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)])
    outer = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measured = measure()
        for batch in slices(batches, limit, text_at):
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in back], *measured(batch.column(text_at))], outer)

    wide = renamed.mapInArrow(run, schema)
    kept = [F.col(inner[i]).alias(names[i]) for i in back if names[i] not in new]
    return wide.select(*kept, *[F.col(f"n{i}").alias(n) for i, n in enumerate(new)])


def files_for(rows: int) -> int:
    """Files for a table of so many short rows, so that a shuffle of many partitions leaves no small files."""
    return 1 + rows // FILE_ROWS


def crc_bucket(column: Column, modulo: int) -> Column:
    """crc32 of a value as text, modulo a number; -1 for null, which is in no bucket."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % F.lit(modulo), F.lit(-1))
