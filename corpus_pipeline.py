"""A corpus pipeline over `documents`: each stage takes and returns whole documents.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import bpe_round_trip
from graphloom.llm.decontaminate import contamination
from graphloom.llm.exact_dedup import exact_duplicates
from graphloom.llm.langid import UNDETERMINED, identify_language, train
from graphloom.llm.shared import files_for, stored, temporary
from graphloom.llm.simhash import near_duplicates

#: A document whose best language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs as its text and one value of all other columns, whose names then clash with nothing; and docs' columns in those terms."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*others).alias("__others"))
    return rows, [F.col(c) if c == "text" else F.col("__others")[c].alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without letters or a likely language go.

    Null and empty texts go.  Nothing but the text decides; columns with any name stay as they are."""
    rows, columns = packed(docs)
    found = identify_language(rows, train(docs, "lang"))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*columns)


#: Rows to drop whose keys are broadcast at most (16 bytes each); more are shuffled with the documents, to a join that can spill.
BROADCAST_KEYS = 1_000_000


def keyed(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join docs to keys (doc_id, text_xxh64, ...) by id and text; a null id is a value, a null text is empty."""
    keys = keys.withColumnsRenamed({c: f"__{c}" for c in keys.columns})
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__text_xxh64"))
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge"), same, how)


def thinned(docs: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """The rows of docs that found (doc_id, text_xxh64, kept, n_keep) keeps, one of those that share doc_id and group.

    Only the keys of what goes, and of rows that repeat, meet the documents.  Of rows that repeat
    the one with the smallest text stays, then that with the smallest JSON text."""
    found = found.select("doc_id", "text_xxh64", "kept", "n_keep", F.col(group).alias("alike"))
    rest = keyed(docs, found.where("not kept or n_keep > 1").select("doc_id", "text_xxh64").distinct(), "left_anti")
    repeated = found.where("kept and n_keep > 1").select("doc_id", "text_xxh64", "alike").distinct()
    if repeated.isEmpty():
        return rest
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = keyed(docs, repeated, "inner").select("__doc_id", "__alike", whole.alias("__row"), F.struct(F.col("text"), F.to_json(whole)).alias("__order"))
    return rest.unionByName(rows.groupBy("__doc_id", "__alike").agg(F.min_by("__row", "__order").alias("__row")).select("__row.*"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id (null last).

    Rows are told apart by id and text, so repeated or null ids do no harm."""
    with temporary(spark):
        found = stored(exact_duplicates(docs).select("doc_id", "text_xxh64", "kept", "n_keep", "text_sha256"), "kept", files_for(docs.count()), outlives=1)
    return thinned(docs, found, "text_sha256")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest doc_id (null last), then the smallest text hash."""
    with temporary(spark):
        found = stored(near_duplicates(docs).select("doc_id", "text_xxh64", "kept"), "kept", files_for(docs.count()), outlives=1)
    times = found.where("kept").groupBy("doc_id", "text_xxh64").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    times = stored(times, "repeated", 1)
    # few or no kept rows repeat both id and text
    again = times.select(F.col("doc_id").alias("i"), F.col("text_xxh64").alias("h"), "n")
    both = found.join(again, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_xxh64") == F.col("h")), "left").withColumn("n_keep", F.coalesce("n", F.lit(1)))
    return thinned(docs, both.select("doc_id", "text_xxh64", "kept", "n_keep"), "text_xxh64")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated; null and empty texts stay."""
    rows, columns = packed(docs)
    found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian uint32) and the text that they decode to."""
    return bpe_round_trip(docs, TOKENIZER)


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", tokenize),
]

#: Trained language scores, XXH64 fingerprints and BPE ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; what a stage stored for itself goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark):
        for number, (name, stage) in enumerate(STAGES, 1):
            with temporary(spark):
                docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", outlives=2 if number == len(STAGES) else 1)
    return docs
