"""Token counts from an exact length histogram.

Documents are counted by encoded length once.  Suffix sums over the lengths then answer
totals, quantiles and totals after truncation for every context limit, without another
look at the texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import attach, stored
from .tokenfile import encoder

#: Neighbouring lengths that are summed together before their totals are chained.
SPAN = 256


def encoded_lengths(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with n_tokens, the number of ids of the whole text; 0 for null and empty texts.

    A column of docs called n_tokens is replaced."""

    def measure():
        coder = encoder(path)

        def measured(text: pa.Array) -> list[pa.Array]:
            return [pa.array(coder.lengths([t or "" for t in text.to_pylist()]), pa.int64())]

        return measured

    return attach(docs, text_col, [T.StructField("n_tokens", T.LongType())], measure, keep=keep)


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row per length that occurs: n_tokens, documents, tokens, documents_at_least,
    tokens_at_least and truncated_tokens (the total if every document were cut to n_tokens).

    Documents are counted with partial sums.  Suffix sums are taken inside spans of SPAN
    lengths in parallel; only the spans' totals are chained.  Null lengths are left out;
    an empty table gives an empty histogram."""
    counts = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("documents"))
    bins = stored(counts.withColumn("span", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("documents")), "lengths")
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    totals = bins.groupBy("span").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    beyond = totals.select("span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"))
    inside = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    summed = bins.join(stored(beyond, "spans"), "span").select(
        "n_tokens", "documents", "tokens",
        (F.sum("documents").over(inside) + F.col("d")).alias("documents_at_least"),
        (F.sum("tokens").over(inside) + F.col("t")).alias("tokens_at_least"),
    )
    total = F.lit(bins.agg(F.sum("tokens")).first()[0] or 0)
    return summed.withColumn("truncated_tokens", total - F.col("tokens_at_least") + F.col("n_tokens") * F.col("documents_at_least"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens in all, tokens kept when every document is
    cut to the limit, and documents cut.  Any limit may be asked, whether it occurs or not.

    The suffix sums of the next longer length answer a limit: what is shorter is kept whole, the
    rest gives `limit` tokens each.  An empty histogram gives zeros for every limit."""
    sums = F.struct("documents_at_least", "tokens_at_least")
    longer = [F.min_by(sums, F.when(F.col("n_tokens") > x, F.col("n_tokens"))).alias(f"after{i}") for i, x in enumerate(limits)]
    whole = histogram.agg(F.coalesce(F.max("documents_at_least"), F.lit(0)).alias("documents"), F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("tokens"), *longer)
    each = F.inline(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("context"), F.col(f"after{i}").alias("after")) for i, x in enumerate(limits)]))
    cut = F.coalesce(F.col("after.documents_at_least"), F.lit(0))
    kept = F.col("tokens") - F.coalesce(F.col("after.tokens_at_least"), F.lit(0)) + F.col("context") * cut
    return whole.select("documents", "tokens", each).select("context", "documents", "tokens", kept.alias("kept_tokens"), cut.alias("cut_documents"))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q: the least length that at least a share q of the documents do not exceed.

    An empty histogram gives no rows."""
    total = F.lit(histogram.agg(F.max("documents_at_least")).first()[0] or 0)
    at_most = total - F.col("documents_at_least") + F.col("documents")
    least = [F.min(F.when(at_most >= F.ceil(F.lit(float(q)) * total), F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]
    each = F.inline(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)]))
    return histogram.agg(*least).select(each).where("n_tokens is not null")
