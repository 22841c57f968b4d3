"""Cases that an operator once left out."""

import pytest

from graphloom.llm import pii


def terms(spark, texts, **options):
    """Marked terms of each document, by id."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(texts[r.doc_id][s.start : s.end], s.action) for s in r.spans if s.kind == "term"] for r in pii.private_spans(docs, **options).collect()}


FILLER = [f"nothing of note here {'abcdefghij'[i % 10] * 3}" for i in range(60)]


@pytest.mark.parametrize("entity", ["{0}.{0}@firm.example", "10.20.{1}.7", "+44 20 7946 {1}1"])
def test_pii_terms_of_entities_in_one_document(spark, entity):
    words = ["anna", "boris", "clara", "david", "elena", "franz"]
    texts = [f"Falcon {word}x writes to {entity.format(word, 100 + i)} soon" for i, word in enumerate(words)]
    got = terms(spark, texts + FILLER)
    for i, word in enumerate(words):
        assert ("Falcon", "remove") in got[i], entity
        assert f"{word}x" not in dict(got[i]), "met once: no evidence"
    assert not any(got[i] for i in range(len(words), len(got)))


def test_pii_one_common_term_is_no_evidence(spark):
    """A term met twice beside a kind that a third of the documents have is chance."""
    texts = [f"{'zebra' if i < 2 else 'horse' if i % 2 else 'mouse'} 10.{i}.{i}.{i}" for i in range(30)] + [f"horse mouse {t}" for t in FILLER]
    assert not any(terms(spark, texts).values())


def test_pii_terms_far_from_the_entity(spark):
    far = "quiet words in between " * 20
    text = f"Falcon {far} a@b.co {far} falcon, FALCON and a@falcon.example"
    got = terms(spark, [text, text + " again", *FILLER])
    for i in (0, 1):
        assert [t for t, _ in got[i] if t.lower() == "falcon"] == ["Falcon", "falcon", "FALCON"], "every place, those in an entity apart"


def test_op4_terms_are_brute_force(spark):
    import math
    import re
    from collections import Counter

    from tests.conftest import DATA

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    # a planted word for kinds and parts, and copies for values
    texts = [r.text or "" for r in rows] + [f"Ünder {'far ' * 30} {'x' * (3 + i)}.0{i}@mail7.example.com, 10.20.{i}.9 ünder" for i in range(9)]
    texts += [next(t for t in texts if "@" in t)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    word = re.compile(r"[^\W\d_]{3,}")
    found = {r.doc_id: r.spans for r in pii.private_spans(docs).collect()}
    keys, words, n_t, n_e, n_et = {}, {}, Counter(), Counter(), Counter()
    for i, text in enumerate(texts):
        chars, mine = list(text), set()
        for s in found[i]:
            if s.kind == "term":
                continue
            value = text[s.start : s.end].lower()
            chars[s.start : s.end] = "\x02" * (s.end - s.start)
            number = re.sub("[^0-9]", "", value)
            octets = value.split(".")
            parts = {"email": [value.split("@")[-1], *word.findall(value.split("@")[0])], "ip": [".".join(octets[:2]), ".".join(octets[:3])], "card": [number[:6]], "phone": [number[:-7], number[:-4]]}[s.kind]
            mine |= {(s.kind, "whole", value), (s.kind, "kind", "")} | {(s.kind, "part", p) for p in parts}
        words[i] = [(m[0].lower(), m.start(), m.end()) for m in word.finditer("".join(chars))]
        keys[i], held = mine, {w for w, _, _ in words[i]}
        n_t.update(held)
        n_e.update(mine)
        n_et.update((k, w) for k in mine for w in held)
    tested = {pair: n for pair, n in n_et.items() if n >= pii.SUPPORT}
    beside = {w for (k, w), n in tested.items() if k[1] == "kind"}
    bound = sum(min(sum(n for (k2, _), n in n_et.items() if k2 == k) // pii.SUPPORT, len(beside)) for k, n in n_e.items() if k[1] != "whole" and n >= pii.SUPPORT)
    assert bound >= sum(k[1] != "whole" for k, _ in tested), "no fewer tests are allowed for than were made"
    disclosure = {}
    for (k, w), n in tested.items():
        if n_e[k] == len(texts):
            continue
        d = math.log2(len(texts) * n / (n_e[k] * n_t[w])) / math.log2(len(texts) / n_e[k])
        p, q = n / n_t[w], n_e[k] / len(texts)
        kl = p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)
        if d >= pii.GENERALISE_AT and (k[1] == "whole" or n_t[w] * kl >= math.log(bound / pii.ALPHA)):
            disclosure[k, w] = d
    assert {k[1] for k, _ in disclosure} >= {"whole", "part"}
    for i in range(len(texts)):
        most = {w: max([disclosure[k, w] for k in keys[i] if (k, w) in disclosure], default=0) for w, _, _ in words[i]}
        want = [(a, b, "remove" if most[w] >= pii.REMOVE_AT else "generalise") for w, a, b in words[i] if most[w]]
        assert [(s.start, s.end, s.action) for s in found[i] if s.kind == "term"] == want
