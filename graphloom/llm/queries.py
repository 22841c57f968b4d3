"""The registered queries: thin wrappers that apply each operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, lengths, pii, quality, tokenfile, toxicity
from .bpe import bpe_round_trip
from .decontaminate import contamination
from .exact_dedup import exact_duplicates
from .html_text import main_text
from .langid import identify_language, train
from .prefix_trie import conversation_trie
from .shared import crc_bucket
from .simhash import near_duplicates

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_ids(table(spark, sf_dir, "documents"), TOKENIZER, end_id=1)
    read = tokenfile.read_ids(spark, manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out), "toxic")
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(table(spark, sf_dir, "documents"), TOKENIZER)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.private_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["action"] == "mask")
    counts = [number_of(kind).alias(f"n_{kind}") for kind in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def number_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out), "quality")
    scored = quality.score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(lengths.encoded_lengths(table(spark, sf_dir, "documents").select("text"), TOKENIZER, keep=[]))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held_out), "lang")
    return identify_language(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated", "longest_words", "longest_at", "longest_item")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), BYTES, PIECES)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), block=20, most=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_file": op1_token_file,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_language": op7_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_html_text": op12_html_text,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id,
               min(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept,
               text_sha256
        FROM d WINDOW same AS (PARTITION BY text_sha256)""",
    "op9_decontaminate": r"""
        WITH dw AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM documents),
        iw AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark),
        ix AS (
          SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p
          FROM iw WHERE len(w) > 0),
        windows AS (SELECT item_id, k, p AS q, array_to_string(w[p : p + k - 1], ' ') AS g FROM ix),
        sizes AS (SELECT DISTINCT k FROM windows),
        dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, sizes WHERE len(w) >= k),
        dg AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM dp),
        found AS (SELECT doc_id, item_id, k, p, q FROM dg JOIN windows USING (k, g)),
        spots AS (SELECT DISTINCT doc_id, p, k FROM found),
        dword AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM dw WHERE doc_id IN (SELECT doc_id FROM spots)),
        iword AS (SELECT item_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM iw),
        equal_words AS (SELECT doc_id, item_id, p, p - q AS diagonal FROM dword JOIN iword USING (word)),
        runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS run FROM equal_words),
        stretches AS (SELECT doc_id, item_id, min(p) AS p, count(*) AS size FROM runs GROUP BY doc_id, item_id, diagonal, run),
        matches AS (
          SELECT doc_id, item_id, s.p - 1 AS place, size FROM stretches s
          WHERE EXISTS (SELECT 1 FROM spots o WHERE o.doc_id = s.doc_id AND o.p >= s.p AND o.p + o.k <= s.p + s.size)),
        longest AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, place, item_id) = 1),
        hits AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS spot FROM found) GROUP BY doc_id),
        items AS (
          SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
               coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
               coalesce(size, 0) AS longest_words, place AS longest_at, longest.item_id AS longest_item
        FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)""",
    "op13_prefix_trie": r"""
        WITH raw AS (
          SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        turns AS (
          SELECT c, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS t, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
                 row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS place
          FROM raw),
        convs AS (
          SELECT c, c - c % 20 AS base,
                 xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1))))) % 4 AS h
          FROM (SELECT DISTINCT c FROM turns)),
        joined AS (
          SELECT convs.c, 0 AS own, place, t, words FROM convs JOIN turns ON turns.c = base AND place <= h
          UNION ALL SELECT convs.c, 1, place, t, words FROM convs JOIN turns ON turns.c = convs.c AND place > h),
        rebuilt AS (SELECT c, t, words, row_number() OVER (PARTITION BY c ORDER BY own, place) AS d FROM joined),
        prefixes AS (
          SELECT c, d, string_agg(t, ',') OVER (PARTITION BY c ORDER BY d) AS name, words FROM rebuilt
          UNION ALL SELECT c, 0, '', 0 FROM convs),
        members AS (SELECT c, d, words, min(c) OVER (PARTITION BY d, name) AS owner, count(*) OVER (PARTITION BY d, name) AS n_convs FROM prefixes),
        nodes AS (
          SELECT n.c AS conv_id, n.d AS depth, n.words, n.n_convs, p.owner AS parent_conv_id
          FROM members n LEFT JOIN members p ON p.c = n.c AND p.d = n.d - 1 WHERE n.c = n.owner),
        children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (conv_id, depth)),
        sums AS (
          SELECT m.owner AS conv_id, m.d AS depth, sum(CAST(below.n_children = 0 AS BIGINT)) AS n_leaves, sum((below.n_convs - 1) * below.words) AS saved
          FROM whole below JOIN members m ON m.c = below.conv_id AND m.d <= below.depth GROUP BY ALL),
        lengths AS (SELECT c, max(d) AS d FROM prefixes GROUP BY c),
        ends AS (SELECT owner AS conv_id, d AS depth, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM members JOIN lengths USING (c, d) GROUP BY ALL)
        SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM whole JOIN sums USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)""",
}
