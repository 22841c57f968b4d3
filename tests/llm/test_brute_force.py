"""Registered queries against slow plain-Python versions of their methods, row by row."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_llm_queries import library, rows, texts  # noqa: F401  (fixtures)

from graphloom.llm import decontaminate, langid, quality, simhash, toxicity
from graphloom.llm.queries import QUERIES, TOKENIZER

MASK = (1 << 64) - 1


def hashed(values):
    """The hash of a word, given its bytes or code points."""
    h = sum((v + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, v in enumerate(values)) & MASK
    return mixed((h + len(values) * 0x94D049BB133111EB) & MASK)


def mixed(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def lowered(raw):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def byte_words(text):
    return [lowered(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]


def bucket(doc, modulo):
    return zlib.crc32(str(doc).encode()) % modulo


def labelled(spark, column, modulo, rest):
    """(text, label) of the training rows in the order in which they are learnt."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", column)
    found = docs.join(known, "doc_id").where(f"{column} is not null").withColumn("place", F.xxhash64("doc_id", "text")).orderBy("place").collect()
    return [(r.text, r[column]) for r in found if bucket(r.doc_id, modulo) != rest]


def test_op2_is_plain_ftrl(spark, texts):  # noqa: F811
    def slots(text):
        words = [hashed(w) for w in byte_words(text)]
        out = set(words)
        for gap, kind in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
            out |= {mixed((a * kind + b) & MASK) for a, b in zip(words, words[gap:], strict=False)}
        return sorted({h >> 44 for h in out})

    train = [(slots(t), y) for t, y in labelled(spark, "toxic", 3, 1)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(s):
        if abs(z[s]) <= 5.0:
            return 0.0
        return -math.copysign(abs(z[s]) - 5.0, z[s]) / ((1.0 + math.sqrt(n[s])) / 2.0)

    for epoch in range(5):
        for k in np.random.default_rng(epoch).permutation(len(train)):
            found, label = train[k]
            at = [*found, "bias"]
            w = [weight(s) for s in at]
            gradient = 1 / (1 + math.exp(-max(-35, min(35, sum(w))))) - label
            for s, v in zip(at, w, strict=True):
                z[s] += gradient - (math.sqrt(n[s] + gradient**2) - math.sqrt(n[s])) / 2.0 * v
                n[s] += gradient**2
    got = rows(spark, "op2_toxicity")
    assert len(got) == len(texts) and any(weight(s) for s in list(z))
    for doc, text in texts.items():
        want = 1 / (1 + math.exp(-max(-35, min(35, sum(weight(s) for s in [*slots(text), "bias"])))))
        assert got[doc].score == pytest.approx(want, abs=1e-5)
        assert got[doc].predicted == (got[doc].score >= 0.7) and got[doc].held_out == (bucket(doc, 3) == 1)


def plain_counts(text):
    shapes, out = lambda t: re.sub(rb"(?s)(.)\1+", rb"\1", bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in t)), Counter()
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    for before, token in zip([None, *tokens], tokens, strict=False):
        out[1 + hashed(shapes(token)) % 511] += 1
        out[0] += before == token
    for word in byte_words(text):
        out[512 + hashed(word) % 1536] += 1
    return [out[k] for k in range(2048)]


def test_op5_is_a_plain_vote(spark, texts):  # noqa: F811
    train = labelled(spark, "quality", 5, 0)
    terms = np.array([plain_counts(t) for t, _ in train], float)
    idf = np.log((1 + len(terms)) / (1 + (terms > 0).sum(0))) + 1

    def unit(v):
        return v / max(np.linalg.norm(v), 1e-12)

    def placed(counts):
        v = np.log1p(np.array(counts, float)) * idf
        return np.concatenate([unit(v[:512]), unit(v[512:])])

    matrix = np.array([placed(t) for t in terms])
    basis = np.linalg.svd(matrix, full_matrices=False)[2][:48].T
    known, labels = [unit(v @ basis) for v in matrix], [y for _, y in train]
    got = rows(spark, "op5_quality")
    apart = 0
    for doc, text in texts.items():
        latent = unit(placed(plain_counts(text)) @ basis)
        cosines = [float(latent @ v) for v in known]
        best = sorted(range(len(known)), key=lambda k: (-cosines[k], k))[:25]
        weights = [max(cosines[k], 1e-6) ** 4 for k in best]
        want = sum(w * labels[k] for w, k in zip(weights, best, strict=True)) / sum(weights) if text.strip() else sum(labels) / len(labels)
        apart = max(apart, abs(got[doc].score - want))
        assert got[doc].predicted == (got[doc].score >= 0.3) and got[doc].held_out == (bucket(doc, 5) == 0)
    assert len(got) == len(texts) and apart < 0.02, "float32 sums may move the last of the voters"


def test_quality_ties_and_empty_texts(spark):
    """Scores do not depend on the order of the labelled rows; texts without terms get the labelled share."""
    docs = [(i, "same words here" if i % 2 else f"other text {i}") for i in range(120)]
    known = [(i, int(i % 4 == 1 or i % 4 == 2)) for i in range(120)]
    probe = spark.createDataFrame([(1000, ""), (1001, None), (1002, "same words here"), (1003, " \n ")], "doc_id long, text string")
    scores = []
    for turn in (1, -1):
        model = quality.train(spark.createDataFrame(docs[::turn], "doc_id long, text string"), spark.createDataFrame(known[::turn], "doc_id long, quality int"), "quality")
        scores.append([r.score for r in quality.score_quality(probe, model).orderBy("doc_id").collect()])
    assert scores[0] == scores[1] and scores[0][0] == scores[0][1] == scores[0][3] == pytest.approx(0.5)
    cosines = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.1, 0.2, 0.3, 0.4, 0.5]])
    assert [sorted(r) for r in quality.nearest(cosines, 3).tolist()] == [[0, 1, 2], [2, 3, 4]]


class PlainBackoff:
    """Words first, then n-grams of falling length, over dictionaries."""

    def __init__(self, pairs, longest=4):
        self.languages, self.longest = sorted({lang for _, lang in pairs}), longest
        self.levels = [defaultdict(Counter) for _ in range(longest + 1)]  # by n-gram length; 0 has the words
        for text, lang in pairs:
            for word in self.words(text):
                self.levels[0][word][lang] += 1
                for size in range(1, longest + 1):
                    for gram in self.grams(word, size):
                        self.levels[size][gram][lang] += 1
        self.totals = [{la: sum(c[la] for c in level.values()) + 0.5 * (len(level) + 1) for la in self.languages} for level in self.levels]

    @staticmethod
    def words(text):
        return regex.findall(r"\p{L}+", (text or "").lower())

    @staticmethod
    def grams(word, size):
        marked = word if size == 1 else f"^{word}$"
        return [marked[i : i + size] for i in range(len(marked) - size + 1)]

    def value(self, size, entry, lang):
        return math.log(self.levels[size][entry][lang] + 0.5) - math.log(self.totals[size][lang])

    def predict(self, text):
        words, logs = self.words(text), dict.fromkeys(self.languages, 0.0)
        if not words:
            return "und", 0.0
        for word in words:
            if word in self.levels[0]:
                for la in logs:
                    logs[la] += self.value(0, word, la)
                continue
            for size in range(self.longest, 0, -1):
                found = [g for g in self.grams(word, size) if g in self.levels[size]]
                if found:
                    for la in logs:
                        logs[la] += 0.4 ** (self.longest + 1 - size) * sum(self.value(size, g, la) for g in found) / len(found)
                    break
        best = max(logs.values())
        name = min(la for la in logs if logs[la] == best)
        return name, 1 / sum(math.exp(v - best) for v in logs.values())


def agree(got, want):
    for (lang, score), (lang2, score2) in zip(got, want, strict=True):
        assert score == pytest.approx(score2, abs=1e-4) and (lang == lang2 or abs(score - 0.5) < 1e-4)


def test_op7_is_plain_backoff(spark, texts):  # noqa: F811
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    plain = PlainBackoff([(r.text, r.lang) for r in docs if r.lang is not None and r.text is not None and bucket(r.doc_id, 5) != 0])
    got = rows(spark, "op7_language")
    agree([(got[d].lang_pred, got[d].score) for d in texts], [plain.predict(t) for t in texts.values()])
    assert all(got[d].held_out == (bucket(d, 5) == 0) for d in texts)


def counted(counts):
    return pa.table({"word": [w for w, _ in counts], "label": [la for _, la in counts], "n": list(counts.values())})


def test_backoff_to_every_length_and_unseen_letters():
    pairs = [("the cat sat", "en"), ("le chat était là", "fr"), ("çà et là", "fr"), ("der Hund saß", "de")]
    plain, counts = PlainBackoff(pairs), Counter()
    for text, lang in pairs:
        counts.update((w, lang) for w in PlainBackoff.words(text))
    model = langid.BackoffModel(counted(counts))
    probe = ["chats", "xtx", "h", "ß", "Çz", "cats et hunde", "привет", "", "12 -", "ÉTAIT là the", "日本"]
    names, scores = model.predict(probe)
    agree(list(zip(names, scores.tolist(), strict=True)), [plain.predict(t) for t in probe])
    assert (names[6], scores[6]) == ("de", pytest.approx(1 / 3)) and names[7] == names[8] == "und"
    # evidence of a shorter n-gram weighs less
    steep, flat = (langid.BackoffModel(counted({("abcd", "x"): 9, ("wxyz", "y"): 9}), backoff=b).predict(["abq"])[1][0] for b in (0.1, 1.0))
    assert 0.5 < steep < flat


def test_language_has_no_limits(spark):
    """More labels than any list, more words than any table: all enter the model."""
    many = spark.createDataFrame([(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} tongue", f"l{i:03}") for i in range(600)], "doc_id long, text string, lang string")
    model = langid.train(many, "lang")
    assert len(model.languages) == 600 and model.predict(["wordbc"])[0] == ["l053"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in "klmn"]
    assert len(words) > 50_000
    wide = spark.createDataFrame([(0, " ".join(words), "a"), (1, "q", "b")], "doc_id long, text string, lang string")
    assert len(langid.train(wide, "lang").words.hashes) == len(words) + 1


def test_op6_is_the_library(spark, texts, library):  # noqa: F811
    lengths = [len(library.encode(t, add_special_tokens=False).ids) for t in texts.values()]
    got = QUERIES["op6_token_counts"](spark, str(DATA)).collect()
    assert {r.n_tokens: r.documents for r in got} == Counter(lengths)
    for r in got:
        rest = [x for x in lengths if x >= r.n_tokens]
        assert (r.tokens, r.documents_at_least, r.tokens_at_least, r.truncated_tokens) == (r.n_tokens * r.documents, len(rest), sum(rest), sum(min(x, r.n_tokens) for x in lengths))


def test_lengths_of_nothing(spark):
    from graphloom.llm import lengths

    none = lengths.length_histogram(spark.createDataFrame([(None,)], "n_tokens long"))
    assert [tuple(r) for r in lengths.truncated_totals(none, [0, 7]).collect()] == [(0, 0, 0, 0, 0), (7, 0, 0, 0, 0)]
    assert lengths.length_quantiles(none, [0.5]).count() == 0


@pytest.mark.parametrize("shared", [1, 2, 3, 4])
def test_every_number_of_shared_blocks_finds_every_link(spark, shared):
    rng = np.random.default_rng(shared)
    codes = set()
    for centre in rng.integers(0, 1 << 63, 40):
        for _ in range(int(rng.integers(1, 40))):
            x = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            codes.add(x)
    codes = np.array(sorted(codes), np.uint64)
    nodes = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    want = simhash.merge(np.arange(len(codes)), *np.nonzero(near))
    signed = codes.view(np.int64).tolist()
    for key_rows in (8192, 16):  # large keys are routed again with more blocks, then cut into chunks
        root = {r.x: r.root for r in simhash.roots(simhash.pointers(nodes, key_rows=key_rows, shared=shared)).collect()}
        assert [root.get(c, c) for c in signed] == [signed[w] for w in want], key_rows


def test_keys_are_taken_a_step_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STEP_ROWS", 8)
    import pyarrow as pa

    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 40, 300))
    codes = rng.integers(0, 1 << 12, 300)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + 7]), pa.array(codes[a : a + 7])], ["key", "fp"]) for a in range(0, 300, 7)]
    out = [pair for b in simhash.connect_partition(4)(iter(batches)) for pair in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert all(any(a in codes[keys == k] and b in codes[keys == k] for k in set(keys.tolist())) for a, b in out)
    distinct = np.unique(codes).astype(np.uint64)
    got = simhash.merge(np.arange(len(distinct)), *(np.searchsorted(distinct, np.array(x, np.uint64)) for x in zip(*out, strict=True)))
    links = [(a, b) for k in set(keys.tolist()) for a in codes[keys == k] for b in codes[keys == k] if int(a ^ b).bit_count() <= 4]
    want = simhash.merge(np.arange(len(distinct)), *(np.searchsorted(distinct, np.array(x, np.uint64)) for x in zip(*links, strict=True)))
    assert (got == want).all()


def test_components_of_a_very_long_chain(spark):
    """Components settle however many rounds they need."""
    order = np.random.default_rng(3).permutation(3000).tolist()
    edges = spark.createDataFrame([(max(a, b), min(a, b)) for a, b in zip(order, order[1:], strict=False)], "x long, p long")
    assert {r.root for r in simhash.roots(edges).collect()} == {0}


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("kind", ["long", "smallint", "string", "decimal(9,2)"])
def test_longest_matches_are_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    docs = [(int(i), " ".join(rng.choice(list("abcde"), rng.integers(0, 30)))) for i in range(25)] + [(None, "a b c"), (77, None), (78, ""), (3, "z z z")]
    items = [(int(i), " ".join(rng.choice(list("abcdez"), rng.integers(1, 20)))) for i in range(12)] + [(50, None), (51, "nowhere"), (52, "")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, words int, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    for size in (1 << 20, 300):  # one block, and several
        got = {int(r.item_id): (r.words, r.doc_id, r.doc_word, r.item_word) for r in decontaminate.longest_matches(d, b, block_bytes=size).collect()}
        want = {}
        for item, text in items:
            words, best = plain_words(text), None
            for doc, body in docs:
                theirs = plain_words(body)
                for p in range(len(theirs)):
                    for q in range(len(words)):
                        n = 0
                        while q + n < len(words) and p + n < len(theirs) and words[q + n] == theirs[p + n]:
                            n += 1
                        key = (-n, q, doc is not None, doc or 0, p)
                        if n and (best is None or key < best):
                            best = key
            if best:
                want[item] = (-best[0], best[3] if best[2] else None, best[4], best[1])
        assert got == want
    assert decontaminate.longest_matches(d.limit(0), b).count() == decontaminate.longest_matches(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["smallint", "string"])
def test_contamination_in_blocks_with_any_kind_of_id(spark, kind):
    docs = spark.createDataFrame([(1, "x one two three y two three four", 9), (2, "four five", 9), (3, None, 9), (None, "one two three", 9)], "doc_id long, text string, n_hit int")
    items = [(1, "one two three"), (2, "two three four"), (2, "five"), (3, "absent words"), (None, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    for size in (1 << 20, 70):
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, window=3, block_bytes=size).collect()}
        value = lambda i: str(i) if kind == "string" else i
        assert (got[1].n_words, got[1].n_hit, set(got[1].item_ids)) == (8, 6, {None, value(1), value(2)})
        assert (got[1].longest_words, got[1].longest_at, got[1].longest_item) == (3, 1, None) and (got[2].longest_words, got[2].longest_at, got[2].longest_item) == (1, 1, value(2))
        assert (got[3].n_words, got[3].n_hit, got[3].longest_words, got[3].longest_at, got[3].contaminated) == (0, 0, 0, None, False)
        assert got[None].contaminated and [tuple(s) for s in got[1].spans] == [(1, 4), (5, 8)]


def test_null_ids_are_not_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(None, "the cat", "en", "s", 7), (1, "le chat", "fr", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op2_toxicity", "op5_quality", "op7_language"):
        got = {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got[None].held_out is False and 0 <= got[None].score <= 1, name


def test_an_id_with_both_labels_is_learnt_once_with_each(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, None), (3, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, known, "toxic", "doc_id", "text", 100, 1).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", 0), (1, "a", 1)]


# ---- the pipeline -----------------------------------------------------------------------


def fingerprint(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def order(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def plain_language(docs):
    plain = PlainBackoff([(r["text"], r["lang"]) for r in docs if r["lang"] is not None and r["text"] is not None])
    return [r for r in docs if (p := plain.predict(r["text"]))[0] != "und" and p[1] >= 0.5]


def plain_exact(docs):
    groups = defaultdict(list)
    for r in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r)
    return [min(g, key=lambda r: (*order(r), r["text"] or "")) for g in groups.values()]


def plain_near(docs):
    import xxhash

    prints = [fingerprint(r["text"] or "") for r in docs]
    label = list(range(len(docs)))
    moved = True
    while moved:
        moved = False
        for a in range(len(docs)):
            for b in range(len(docs)):
                if label[a] < label[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[b], moved = label[a], True
    groups = defaultdict(list)
    for r, k in zip(docs, label, strict=True):
        groups[k].append(r)
    signed = lambda t: (h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (1 << 64 if h >> 63 else 0)
    return [min(g, key=lambda r: (*order(r), signed(r["text"]))) for g in groups.values()]


def plain_clean(docs, items):
    windows = {tuple(w[i : i + 13]) for _, t in items if (w := plain_words(t)) for i in range(max(1, len(w) - 12))}
    sizes, out = {len(w) for w in windows}, []
    for r in docs:
        words = plain_words(r["text"])
        hit = {i + j for k in sizes for i in range(len(words) - k + 1) if tuple(words[i : i + k]) in windows for j in range(k)}
        if not (hit and 20 * len(hit) >= len(words)):
            out.append(r)
    return out


def test_pipeline_is_brute_force(spark, library):  # noqa: F811
    import corpus_pipeline

    docs = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = plain_clean(plain_near(plain_exact(plain_language(docs))), items)
    assert len(kept) < len(docs)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(DATA)).collect()}
    assert sorted(got) == sorted(r["doc_id"] for r in kept)
    for r in kept:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert np.frombuffer(got[r["doc_id"]].ids, "<u4").tolist() == ids and got[r["doc_id"]].decoded == library.decode(ids, skip_special_tokens=False)


def test_pipeline_stages_tell_rows_apart(spark, monkeypatch):
    """Repeated and null ids, rows that repeat as a whole, and columns with the names of new ones."""
    import corpus_pipeline

    a, b, c = "the same words in both of these two rows here", "quite other words stand in this one alone", "and a third text about nothing in particular"
    pairs = [(5, a), (6, a), (6, b), (None, a), (None, c), (5, a.replace(" ", "  ")), (5, b), (3, b), (7, None), (None, ""), (8, c.upper()), (8, c.upper()), (5, a)]
    columns = "doc_id long, text string, lang string, source string, score double, n_words int, kept boolean, lang_pred string, tags array<string>"
    docs = spark.createDataFrame([(i, t, "en", "s", 7.0, -5, True, "zz", [str(k)]) for k, (i, t) in enumerate(pairs)], columns)
    plain = [r.asDict() for r in docs.collect()]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    stages = dict(corpus_pipeline.STAGES)
    for limit in (1_000_000, 0):  # keys broadcast, and keys shuffled
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", limit)
        for name, slow in (("exact_dedup", plain_exact), ("near_dedup", plain_near)):
            out = stages[name](spark, docs, str(DATA))
            assert out.columns == docs.columns
            got = [r.asDict() for r in out.collect()]
            assert sorted(map(key, got)) == sorted(map(key, slow(plain))), name
    for name in ("language", "decontaminate"):
        out = stages[name](spark, docs, str(DATA))
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all((r.score, r.n_words, r.lang_pred, r.kept) == (7.0, -5, "zz", True) for r in got), name
