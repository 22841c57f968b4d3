"""The registered queries on the smallest tables: against SQL, or against brute force."""

import hashlib
import re
import zlib

import pytest

from tests.conftest import DATA
from tests.test_queries import same_rows

from graphloom.llm.queries import QUERIES, SQL, TOKENIZER

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def rows(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, str(DATA)).collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, str(DATA)), duck.sql(SQL[name]))


def test_op1_is_the_library_in_order(spark, texts, library):
    got, at = rows(spark, "op1_token_file"), 0
    for doc in sorted(texts):
        ids = [*library.encode(texts[doc], add_special_tokens=False).ids, 1]
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(packed))
        at += len(ids)


def test_op3_is_the_library(spark, texts, library):
    got = rows(spark, "op3_bpe")
    for doc, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op10_is_brute_force(spark, texts):
    import xxhash

    def fingerprint(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {doc: fingerprint(text) for doc, text in texts.items()}
    label = {doc: doc for doc in prints}
    moved = True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if label[a] < label[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[b], moved = label[a], True
    got = rows(spark, "op10_simhash")
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{prints[d]:016x}", label[d]) for d in prints}


def test_op4_base_spans_are_brute_force(spark, texts):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    got = rows(spark, "op4_pii")
    for doc, text in texts.items():
        spans = []
        for rank, (kind, pattern) in enumerate(kinds):
            for m in re.finditer(pattern, text):
                number = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(number) <= 19 and luhn(number)) or kind == "phone" and not 10 <= len(number) <= 15:
                    continue
                spans.append((m.start(), rank, kind, m.end()))
        spans.sort()
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert got[doc].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [s for s in got[doc].spans.split(",") if s and not s.startswith("term:")] == [s for s in listed.split(",") if s]
        assert [got[doc][f"n_{kind}"] for kind, _ in kinds] == [sum(s[2] == kind for s in spans) for kind, _ in kinds]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def truth(spark, column):
    return {r.doc_id: r[column] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()} if column != "lang" else {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang").collect()}


@pytest.mark.parametrize("name, column, field, least", [("op2_toxicity", "toxic", "predicted", 0.95), ("op5_quality", "quality", "predicted", 0.97), ("op7_language", "lang", "lang_pred", 0.97)])
def test_held_out_accuracy(spark, name, column, field, least):
    got, known = QUERIES[name](spark, "/root/testdata/sf0.1").collect(), truth(spark, column)
    judged = [r for r in got if r.held_out and r.doc_id in known]
    assert len(got) == 10_000 and all(0 <= r.score <= 1 for r in got)
    assert sum(r[field] == known[r.doc_id] for r in judged) >= least * len(judged)
    if field == "predicted":  # recall and false alarms apart: most rows are of one kind
        # toxicity: measured 99 of 144 here, where 2,600 labelled rows show too few of the words; more of them, more recall
        recall, alarms = (0.65, 0.01) if column == "toxic" else (0.99, 0.05)
        share = {kind: [r[field] for r in judged if known[r.doc_id] == kind] for kind in (0, 1)}
        assert sum(share[1]) >= recall * len(share[1]) and sum(share[0]) <= alarms * len(share[0])
    modulo, rest = (3, 1) if column == "toxic" else (5, 0)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulo == rest) for r in got)


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, str(DATA))
    kept = {r.doc_id for r in out.collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    exact = {r.doc_id for r in QUERIES["op8_exact_dedup"](spark, str(DATA)).where("kept").collect()}
    assert kept <= exact and len(kept) > 0.7 * len(exact)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(DATA)).columns == docs.columns, name
