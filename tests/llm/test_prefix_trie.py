"""Conversation prefixes against a trie of plain tuples."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from graphloom.llm import prefix_trie
from graphloom.llm.prefix_trie import conversation_trie, turns_in_order
from graphloom.llm.shared import stored


def turn_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def conversations_of(rows, block, most):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, turn_key(role or "", text or ""), role or "", text or ""))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    if block is None:
        return own
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        rebuilt[c] = own.get(c - int(math.fmod(c, block)), [])[:h] + turns[h:]  # remainders as SQL takes them
    return rebuilt


def brute(rows, block=20, most=4):
    whole = conversations_of(rows, block, most)
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    out = {}
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        inner = {m[:-1] for m in members if m}
        ends = [c for c in convs if len(whole[c]) == len(node)]
        out[convs[0], len(node)] = (
            members[node[:-1]][0] if node else None, len(convs), sum(len(m) == len(node) + 1 for m in below), sum(m not in inner for m in below),
            sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def got(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, n_convs int"


def made(seed, convs, deep):
    pick = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = pick.randrange(-5, 3 * convs)
        for turn in range(pick.randrange(1, deep)):
            rows.append((c, pick.choice([None, turn, turn, turn]), pick.choice(["user", "user", None]), pick.choice(["a", "a b", "", None, "c  d\te"])))
    return rows


@pytest.mark.parametrize("seed, convs, deep", [(1, 60, 4), (2, 25, 40), (3, 90, 9)])
def test_trie_is_brute_force(spark, seed, convs, deep):
    rows = made(seed, convs, deep) + [(None, 1, "user", "nobody's")]
    talk = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(5)
    assert got(conversation_trie(talk, block=20)) == brute(rows)


def test_one_hot_conversation_and_one_hot_node(spark):
    """A long conversation over many ranges; a hundred equal ones; chunks and pieces smaller than both."""
    rows = [(40, t, "user", f"t{t % 3}") for t in range(150)]
    rows += [(c, t, "user", f"t{t}") for c in range(1000, 1100) for t in range(3)]
    talk = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert got(conversation_trie(talk)) == brute(rows, None)
    turns = stored(turns_in_order(talk), "turns")
    lengths = turns.groupBy("c").agg({"place": "max"}).withColumnRenamed("max(place)", "n")
    assert got(prefix_trie.trie(turns, lengths, chunk=7, piece=3)) == brute(rows, None)


def test_no_rows_and_no_turns(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA), block=20).collect() == []
    # conversation 21 takes h turns of 20, which is absent, and loses its first h: crc32("21") % 4 tells how many are left
    rows = [(c, 0, "user", "x") for c in (21, 22, 23, 24, 45)]
    talk = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert got(conversation_trie(talk, block=20)) == brute(rows)
    gone = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 and c % 20][:3]
    rows = [(c, 0, "user", "x") for c in gone]
    talk = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    nodes = got(conversation_trie(talk, block=20))
    assert nodes == brute(rows) and list(nodes) == [(gone[0], 0)]
    assert nodes[gone[0], 0][1:4] == (3, 0, 1)


def test_very_long_texts(spark):
    rows = [(0, 0, "user", "w " * 200_000), (20, 0, "user", "w " * 200_000)]
    talk = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert got(conversation_trie(talk, block=20)) == brute(rows)
