"""Alignment of two tokenizers against brute force over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from graphloom.llm import alignment
from graphloom.llm.queries import BYTES, PIECES, QUERIES
from tests.conftest import DATA


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def byte_level():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def groups_of(text, library):
    """Tokens cut where the ends of both sides meet, by byte offsets of the whole text."""
    a, b = library
    letters = byte_level()
    if not text:
        return []
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if any(b"".join(x for _, x in side) != whole for side in (left, right)):
        return []
    ends, found = [], []
    for side in (left, right):
        at, mine = 0, []
        for _, x in side:
            at += len(x)
            mine.append(at)
        ends.append(mine)
    before = 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        found.append(tuple([i for (i, _), e in zip(side, mine) if before < e <= cut] for side, mine in zip((left, right), ends)))
        before = cut
    return found


def expected(texts, library):
    groups = [groups_of(t, library) for t in texts]
    links = [Counter((x, y) for g in one for x in g[0] for y in g[1]) for one in groups]
    held = Counter(pair for one in links for pair in one)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for one, linked in zip(groups, links):
        listed = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in one)
        rows.append((sum(len(x) for x, _ in one), sum(len(y) for _, y in one), len(one), sum(linked.values()), sum(n for p, n in linked.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in linked.items()), hashlib.sha256(listed.encode()).hexdigest() if listed else ""))
    return rows, held, best


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_is_brute_force(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    want, _, _ = expected(docs.values(), library)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_alignment"](spark, str(DATA)).collect()}
    assert got == dict(zip(docs, want))


def odd_texts():
    pick = random.Random(11)
    letters = [*"ab1 '\n\t.,é日😀s<>|\x00", " ", "  ", "　", "▁"]
    made = ["".join(pick.choice(letters) for _ in range(pick.randrange(40))) for _ in range(400)]
    return [None, "", " ", "a  b", " x", "x ", "▁", "<s> </s> <|endoftext|>x", "don't 's", "日本語 テスト", "same text", "same text", "x" * 5000, "ab " * 4000, *made]


@pytest.mark.parametrize("slice_bytes", [64, 1 << 20])
def test_odd_texts_in_slices_of_any_size(spark, library, slice_bytes):
    texts = odd_texts()
    want, held, best = expected(texts, library)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.alignment(docs, BYTES, PIECES, slice_bytes=slice_bytes).collect()}
    assert got == dict(enumerate(want))
    pairs = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in alignment.pair_counts(docs, BYTES, PIECES, slice_bytes=slice_bytes).collect()}
    assert pairs == {p: (n, n == best[p[0]]) for p, n in held.items()}


def test_groups_as_text(spark, library):
    texts = ["Hello world", "", None, "▁", "naïve café 😀"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.groups for r in alignment.token_groups(docs, BYTES, PIECES).collect()}
    assert got == {i: ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups_of(t, library)) for i, t in enumerate(texts)}


def test_a_full_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_WORDS", 3)
    monkeypatch.setattr(alignment, "REMEMBERED", 2)
    pair = alignment.Pair(BYTES, PIECES)
    texts = [t or "" for t in odd_texts()]
    for at in range(0, len(texts), 50):
        _, groups, *_ = pair.measure(texts[at : at + 50])
        assert groups == [";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups_of(t, library)) for t in texts[at : at + 50]]
        assert len(pair.places) <= 3


def test_texts_are_whole_where_cuts_are_not_allowed(library, monkeypatch):
    pair = alignment.Pair(BYTES, PIECES)
    assert pair.cuts
    monkeypatch.setattr(pair, "cuts", False)
    texts = ["one two  three", "", "naïve café"]
    assert pair.measure(texts)[1] == [";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups_of(t, library)) for t in texts]


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(none, BYTES, PIECES).collect() == []
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    rows = sorted(alignment.alignment(same, BYTES, PIECES).collect(), key=lambda r: (r.doc_id is None, r.n_a == 0))
    assert [(r.doc_id, r.n_links, r.count_sum) for r in rows] == [(1, 2, 6), (1, 2, 6), (None, 2, 6), (None, 0, 0)]
