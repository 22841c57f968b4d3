"""Exact duplicates with a heavy-hitter split.

1. One pass over the texts makes (id, digest); that small table is stored.
2. Misra-Gries summaries, one per partition, name every digest that may hold more
   than 1/(k+1) of the rows.  Their true sizes are counted with map-side partial
   sums, and these verified winners (at most k rows) are broadcast: their copies
   are settled without a shuffle.
3. The other digests, none of which is frequent, are shuffled by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ID, TEXT, id_text, stored

#: Counters of a Misra-Gries summary; no more winners than this are broadcast.
COUNTERS = 1024


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def misra_gries(counters: int):
    """mapInArrow body: (digest) rows to at most `counters` (digest, n) rows a task."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            counts = batch.column(0).value_counts()
            for digest, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True):
                kept[digest] = kept.get(digest, 0) + n
            if len(kept) > counters:
                # weighted decrement: subtract the (counters+1)-th largest count from all
                cut = int(np.partition(np.fromiter(kept.values(), np.int64, len(kept)), -counters - 1)[-counters - 1])
                kept = {d: n - cut for d, n in kept.items() if n > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "n"])

    return summarise


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_keep, text_xxh64.

    Texts are equal when identical after normalised(); null counts as empty.  The
    smallest id of equal texts stays (kept).  group_size counts rows.  Ids that are
    null come after all others; if a whole group has null ids, keep_id is null and
    its rows are all kept.  Rows that repeat both id and text are all marked kept;
    n_keep says how many rows share keep_id, so a caller can thin them.  text_xxh64 is a
    hash of the text as it stands (null as empty): with the id it names a row, also where
    ids repeat or are null.  An empty table gives an empty result.
    """
    rows = id_text(docs, id_col, text_col).select(ID, F.unhex(F.sha2(normalised(F.col(TEXT)), 256)).alias("digest"), F.xxhash64(TEXT).alias("text_xxh64"))
    rows = stored(rows, "digests")
    frequent = (
        rows.select("digest").mapInArrow(misra_gries(counters), "digest binary, n long")
        .groupBy("digest").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    )
    frequent = stored(frequent, "frequent", 1)
    winners = stored(groups(rows.join(F.broadcast(frequent), "digest", "left_semi")).where("group_size > 1"), "winners", 1)
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = rest.join(groups(rest), "digest")
    return heavy.unionByName(light).select(
        F.col(ID).alias(id_col),
        "keep_id",
        "group_size",
        F.col(ID).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_keep",
        "text_xxh64",
    )


def groups(rows: DataFrame) -> DataFrame:
    """Size, smallest id and the rows with that id for each digest; partial sums first."""
    by_id = rows.groupBy("digest", ID).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col(ID).isNull().alias("none"), F.col(ID), "n"))
    return by_id.groupBy("digest").agg(F.sum("n").alias("group_size"), first.alias("first")).select("digest", "group_size", F.col(f"first.{ID}").alias("keep_id"), F.col("first.n").alias("n_keep"))
