"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, exact_dedup, langid, pii, quality, simhash, tokenfile, toxicity
from graphloom.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, score double, lang_pred string, n_hit int, fp int, digest string, ids int"
LONG = " ".join(f"wörd{i % 997}" for i in range(60_000))


def table(spark, pairs):
    """Documents with columns whose names clash with those that operators use or add."""
    return spark.createDataFrame([(i, t, "en", 9.0, "zz", 1, 2, "d", 3) for i, t in pairs], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    pairs = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "One two"), (6, "one  two"), (6, "one  two"), (None, "One two"), (None, None), (7, "😀 ٣ \x00 <|endoftext|> don't"), (8, "x" * 20_000), (9, "1" * 5000)]
    return table(spark, pairs)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_exact_dedup(spark, odd, none):
    got = by_id(exact_dedup.exact_duplicates(odd))
    assert (got[1][0].keep_id, got[1][0].group_size, got[1][0].kept) == (1, 3, True)  # null, empty, null id
    assert not got[2][0].kept and got[3][0].group_size == 1
    assert got[5][0].keep_id == 5 and got[5][0].group_size == 2
    assert len(got[6]) == 2 and all(r.kept and r.n_keep == 2 and r.group_size == 2 for r in got[6])
    assert sorted((r.keep_id, r.kept) for r in got[None]) == [(1, False), (5, False)]
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_exact_dedup_with_hot_groups(spark):
    pairs = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)]
    got = by_id(exact_dedup.exact_duplicates(table(spark, pairs), counters=4))
    want = {}
    for i, t in pairs:
        want.setdefault(t, []).append(i)
    for t, members in want.items():
        for i in members:
            assert (got[i][0].keep_id, got[i][0].group_size) == (min(members), len(members))


def test_misra_gries_keeps_every_frequent_digest():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    values = [b"a"] * 400 + [b"b"] * 250 + [bytes([c]) * 2 for c in rng.integers(0, 200, 1000).tolist()]
    rng.shuffle(values)
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 97], pa.binary())], ["digest"]) for i in range(0, len(values), 97)]
    kept = next(exact_dedup.misra_gries(8)(iter(batches)))
    assert kept.num_rows <= 8 and {b"a", b"b"} <= set(kept.column(0).to_pylist())


def test_simhash(spark, odd, none):
    got = by_id(simhash.near_duplicates(odd))
    assert got[1][0].fingerprint == "0" * 16 and got[1][0].component_id == got[3][0].component_id == 1
    assert got[5][0].fingerprint == got[6][0].fingerprint and got[6][1].component_id == 5
    assert {r.component_id for r in got[None]} == {1, 5}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_gray_forest_connects_what_brute_force_does(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    codes = []
    for c in centres:
        for _ in range(rng.integers(1, 60)):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            codes.append(x)
    codes = np.unique(np.array(codes, np.uint64))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    want = simhash.merge(np.arange(len(codes)), *np.nonzero(near))
    x, p = simhash.connect(np.zeros(len(codes), np.int64), codes, block=64)
    got = simhash.merge(np.arange(len(codes)), np.searchsorted(codes, x), np.searchsorted(codes, p))
    assert (got == want).all()


def test_hot_keys_are_dealt_in_chunks(spark):
    rng = np.random.default_rng(5)
    base, codes = 0x123456789ABCDEF0, set()
    while len(codes) < 600:
        x = base
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            x ^= 1 << int(b)
        codes.add(x)
    codes = np.array(sorted(codes), np.uint64)
    nodes = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    root = {r.x: r.root for r in simhash.roots(simhash.pointers(nodes, key_rows=32)).collect()}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    want = simhash.merge(np.arange(len(codes)), *np.nonzero(near))
    signed = codes.view(np.int64).tolist()
    assert [root.get(c, c) for c in signed] == [signed[w] for w in want]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(50)] + [(100 + i, 60 + i % 2) for i in range(40)] + [(61, 60)], "x long, p long")
    got = {r.x: r.root for r in simhash.roots(edges).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {61: 60} | {100 + i: 60 for i in range(40)}


def test_language(spark, odd, none):
    train = table(spark, [(i, t) for i, t in enumerate(["the cat and the dog"] * 5)]).unionByName(table(spark, [(9, "le chat et le chien")]).withColumn("lang", F.lit("fr")))
    model = langid.train(train, "lang")
    assert model.languages == ["en", "fr"]
    rows = langid.identify_language(odd, model)
    assert rows.columns == [c for c in odd.columns if c not in ("score", "lang_pred")] + ["lang_pred", "score"]
    got = by_id(rows)
    assert got[1][0].lang_pred == got[2][0].lang_pred == got[9][0].lang_pred == "und" and got[2][0].score == 0
    probe = by_id(langid.identify_language(table(spark, [(1, "the dog"), (2, "Le Chien!"), (3, "chiens")]), model))
    assert [probe[i][0].lang_pred for i in (1, 2, 3)] == ["en", "fr", "fr"]
    empty = langid.train(none, "lang")
    assert by_id(langid.identify_language(odd, empty))[5][0].lang_pred == "und"
    assert langid.identify_language(none, model).count() == 0


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "One, TWO"), (2, None), (3, ""), (4, LONG[:400]), (5, "nothing of the kind"), (5, "nothing of the kind")], "item_id long, text string")
    got = by_id(decontaminate.contamination(odd, bench))
    assert got[5][0].item_ids == [1] and got[5][0].n_hit == 2 and got[5][0].contaminated
    assert got[1][0].n_words == 0 and not got[1][0].contaminated and got[1][0].spans == []
    assert got[4][0].item_ids == [4] and not got[4][0].contaminated is None
    blocks = by_id(decontaminate.contamination(odd, bench, block_bytes=100))
    key = lambda r: (r.n_words, r.n_hit, [tuple(s) for s in r.spans], sorted(r.item_ids), r.contaminated)
    assert {i: sorted(map(key, rs)) for i, rs in blocks.items()} == {i: sorted(map(key, rs)) for i, rs in got.items()}
    assert decontaminate.contamination(none, bench).count() == 0
    assert by_id(decontaminate.contamination(odd, bench.limit(0)))[5][0].n_hit == 0


def test_longest_matches(spark):
    docs = table(spark, [(1, "a b c d e f"), (2, "x b c d e y"), (3, "b c d e f g")])
    bench = spark.createDataFrame([(7, "z b c d e f q"), (8, "nope")], "item_id long, text string")
    found = decontaminate.longest_matches(docs, bench, window=3).collect()
    assert [tuple(r) for r in found] == [(7, 5, 1, 1, 1)]


def test_bpe(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    for r, s in zip(bpe.bpe_round_trip(odd, TOKENIZER).collect(), odd.collect(), strict=True):
        want = library.encode(s.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.bpe_round_trip(none, TOKENIZER).count() == 0


def test_bpe_overlapping_pairs():
    coder = bpe.vocabulary(TOKENIZER)
    words = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)] + ["aab" * 7, "zzzzzz"]
    ids, counts = coder.merge_all([w.encode() for w in words])
    ends = np.cumsum(counts)
    for w, a, b in zip(words, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == coder.library.encode(w, add_special_tokens=False).ids


def test_token_file(spark, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    manifest = tokenfile.write_ids(odd.repartition(3), TOKENIZER, end_id=1)
    read = tokenfile.read_ids(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in read] == [None, None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    text = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    at = 0
    for r in read:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids[-1] == 1
        if r.doc_id is not None:
            assert ids[:-1] == library.encode(text[r.doc_id], add_special_tokens=False).ids
        at += len(ids)
    assert tokenfile.read_ids(spark, tokenfile.write_ids(none, TOKENIZER)).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packed_shard_has_random_access(tmp_path, bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 3, 700, 1, 2000, 0)]
    writer = tokenfile.ShardWriter(f"file://{tmp_path}/s.ids", bits, block=256)
    for i, ids in enumerate(docs):
        writer.add(i if i else None, ids)
    writer.close()
    reader = tokenfile.ShardReader(f"file://{tmp_path}/s.ids")
    assert all((reader.document(i) == ids).all() for i, ids in enumerate(docs))
    whole = np.concatenate(docs)
    for a, b in ((0, 0), (0, 5), (255, 257), (100, 2000), (0, len(whole))):
        assert (reader.ids(a, b) == whole[a:b]).all()
    assert reader.null.tolist() == [True] + [False] * 5 and not list(tmp_path.glob("*.part"))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


def test_toxicity(spark, odd, none):
    texts = [(i, f"you utter fool number{i}" if i % 3 == 0 else f"a kind word number{i}") for i in range(300)]
    known = labels(spark, [(i, int(i % 3 == 0), 1) for i in range(300)] + [(4, None, None), (999, 1, 1)])
    docs = table(spark, texts)
    model = toxicity.train(docs, known, "toxic")
    got = by_id(toxicity.score_toxicity(docs, model))
    assert all((got[i][0].score >= 0.7) == (i % 3 == 0) for i in range(300))
    scores = by_id(toxicity.score_toxicity(odd, model))
    assert scores[1][0].score == scores[2][0].score and 0 <= scores[4][0].score <= 1
    assert by_id(toxicity.score_toxicity(odd, toxicity.train(none, known, "toxic")))[1][0].score == 0.5
    assert toxicity.score_toxicity(none, model).count() == 0


def test_quality(spark, odd, none):
    texts = [(i, " ".join(["LOUD!!"] * (3 + i % 5)) if i % 4 == 0 else f"Quiet words of plain prose, {i} of them.") for i in range(200)]
    known = labels(spark, [(i, 0, int(i % 4 != 0)) for i in range(200)])
    docs = table(spark, texts)
    model = quality.train(docs, known, "quality")
    got = by_id(quality.score_quality(docs, model))
    assert all((got[i][0].score >= 0.3) == (i % 4 != 0) for i in range(200))
    scores = by_id(quality.score_quality(odd, model))
    assert all(0 <= r.score <= 1 for rs in scores.values() for r in rs)
    assert by_id(quality.score_quality(odd, quality.train(none, known, "quality")))[1][0].score == 0.5
    assert quality.score_quality(none, model).count() == 0


def test_pii(spark, odd, none):
    text = "Mail Anna Kowalska a@b.co, c@d.e.f_x@y.z at 1.2.3.4.5.6.7.8 or 300.1.1.1; card 4111 1111 1111 1111, call +44 (20) 7946-0958."
    docs = table(spark, [(1, text), (1, text), (2, text), (3, None), (4, ""), (5, "é" * 5000 + " q@r.s"), (6, "1" * 5000), (7, "\x01a@b.co\x01")] + [(100 + i, f"words of number {i} here") for i in range(60)])
    got = by_id(pii.private_spans(docs))
    kinds = [(s.kind, text[s.start : s.end]) for s in got[1][0].spans if s.action == "mask"]
    assert kinds == [("email", "a@b.co"), ("email", "c@d.e.f"), ("email", "_x@y.z"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111 1111 1111"), ("phone", "+44 (20) 7946-0958")]
    terms = {text[s.start : s.end] for s in got[1][0].spans if s.kind == "term"}
    assert {"Anna", "Kowalska", "Mail"} <= terms and len(got[1]) == 2 and got[1][0].spans == got[1][1].spans == got[2][0].spans
    assert got[3][0].spans == got[4][0].spans == got[6][0].spans == []
    assert [(s.start, s.end) for s in got[5][0].spans] == [(5001, 5006)]
    assert [(s.kind, s.start, s.end) for s in got[7][0].spans][:1] == [("email", 1, 7)]
    clean = pii.private_spans(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").where("doc_id = 2").select(pii.sanitised(F.col("text"), F.col("spans"))).first()[0]
    assert "Kowalska" not in clean and "[EMAIL]" in clean and "4111" not in clean
    assert pii.private_spans(none).count() == 0
    assert len(pii.private_spans(odd).collect()) == odd.count()


def test_pii_runs_no_python(spark, odd):
    plan = pii.private_spans(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lengths(spark, odd, none):
    from tokenizers import Tokenizer

    from graphloom.llm import lengths

    library = Tokenizer.from_file(TOKENIZER)
    want = [len(library.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()]
    histogram = lengths.length_histogram(lengths.encoded_lengths(odd, TOKENIZER)).persist()
    got = {r.n_tokens: r for r in histogram.collect()}
    assert {n: r.documents for n, r in got.items()} == {n: want.count(n) for n in set(want)}
    for n, r in got.items():
        rest = [x for x in want if x >= n]
        assert (r.documents_at_least, r.tokens_at_least, r.truncated_tokens) == (len(rest), sum(rest), sum(min(x, n) for x in want))
    for r in lengths.truncated_totals(histogram, [0, 1, 3, 4096, 10**9]).collect():
        assert (r.documents, r.tokens, r.kept_tokens, r.cut_documents) == (len(want), sum(want), sum(min(x, r.context) for x in want), sum(x > r.context for x in want))
    ordered = sorted(want)
    for r in lengths.length_quantiles(histogram, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == ordered[-(-round(r.share * 1000) * len(want) // 1000) - 1]
    assert lengths.length_histogram(lengths.encoded_lengths(none, TOKENIZER)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    sf_dir = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0, name
        if name != "bpe":
            assert empty.columns == docs.columns
    run = {name: stage(spark, docs, sf_dir) for name, stage in corpus_pipeline.STAGES}
    assert sorted(r.doc_id or 0 for r in run["language"].collect()) == [0, 4, 5, 6, 6, 7, 8]
    assert sorted(r.doc_id or 0 for r in run["exact_dedup"].collect()) == [1, 3, 4, 5, 6, 7, 8, 9]
    assert run["bpe"].count() == docs.count() and run["decontaminate"].count() == docs.count()
    near = [r.doc_id for r in run["near_dedup"].collect()]
    assert 1 in near and 2 not in near and 5 in near and 6 not in near and None not in near
