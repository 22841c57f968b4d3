"""The longest match of a document that holds a window: short items inside long ones, several blocks, SQL."""

import random
import re

import duckdb
import pandas as pd
import pytest

from graphloom.llm import decontaminate
from graphloom.llm.queries import SQL

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(doc, items, window=13):
    words = WORDS.findall(doc)
    spots = set()
    for _, text in items:
        w = WORDS.findall(text)
        k = min(window, len(w))
        for q in range(len(w) - k + 1 if w else 0):
            spots |= {(p, k) for p in range(len(words) - k + 1) if words[p : p + k] == w[q : q + k]}
    best = (0, None, None)
    for name, text in sorted(items):
        w = WORDS.findall(text)
        for p in range(len(words)):
            for q in range(len(w)):
                n = 0
                while p + n < len(words) and q + n < len(w) and words[p + n] == w[q + n]:
                    n += 1
                if any(p <= s and s + k <= p + n for s, k in spots) and (n, -p) > (best[0], -best[1] if best[1] is not None else 1):
                    best = (n, p, name)
    return best


NESTED = [("A", "aa bb cc dd ee"), ("B", "x1 x2 x3 x4 aa bb cc dd ee ff gg hh y1 y2 y3 y4 y5 y6 y7 y8"), ("C", "dd"), ("D", "")]
DOCS = ["foo aa bb cc dd ee ff gg hh bar x", "foo x3 x4 aa bb cc dd ee zz", "aa bb cc dd", "aa bb cc dd ee aa bb cc dd ee ff", "x4 aa bb cc dd ee", "dd", "nothing", "", NESTED[1][1] * 2, "x1 x2 x3 x4 aa bb cc"]


def made():
    pick = random.Random(9)
    items = [(f"i{n:02d}", " ".join(pick.choice("abcd") for _ in range(pick.choice([0, 1, 3, 5, 14, 25])))) for n in range(12)]
    docs = [" ".join(pick.choice("abcde") for _ in range(pick.randrange(40))) for _ in range(25)] + [f"e {items[k][1]} e {items[k + 1][1]}" for k in range(10)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 25, 150])
@pytest.mark.parametrize("docs, items", [(DOCS, NESTED), made()])
def test_longest_is_brute_force_and_sql(spark, docs, items, block_bytes):
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = decontaminate.contamination(rows, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block_bytes).collect()
    got = {r.doc_id: (r.longest_words, r.longest_at, r.longest_item) for r in found}
    assert got == {i: brute(d, items) for i, d in enumerate(docs)}
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame({"doc_id": range(len(docs)), "text": docs}))
    duck.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    said = duck.sql(SQL["op9_decontaminate"])
    assert {r["doc_id"]: (r["longest_words"], r["longest_at"], r["longest_item"]) for r in (dict(zip(said.columns, row)) for row in said.fetchall())} == got
