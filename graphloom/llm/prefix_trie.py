"""The trie of conversation prefixes, by prefix doubling.

1. Equal turns get one dense name.  In round k, each block of 2^k turns that begins at a
   multiple of 2^k gets the name of its pair of half blocks: a join round for each doubling.
2. The prefix of length d is made of at most log2(d) such blocks, by the bits of d from the
   highest.  Prefixes with one bit are blocks; those with r bits are named, in round r, by the
   prefix without the lowest bit and the block of that bit.
3. Conversations with the same (length, name) share a node.  What a node says of its subtree
   is a sum over its members: the node at depth j of conversation c belongs to its smallest
   member, so c adds the words of the later nodes that it does not own, and 1 if it owns a leaf.

Turns travel as hashes; texts are read once.  A conversation or a first turn may hold a third of
all rows: turns are numbered in ranges, sums run in chunks, names are joined from tables
of distinct keys, and the ids that end at a node are joined and hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import files_for, small_arrow_batches, stored, temporary

WORDS = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation whose later words are summed in one window.
CHUNK = 4096
#: Ids in one piece of the list that ends at a node.
PIECE = 1 << 16


def turns_in_order(talk: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, place, turn, words): each conversation's turns, numbered from 1, with a SHA-256 of role and text.

    Turns are in order of turn_col, null first; of equal ones the smaller hash comes first.  Null
    role or text is empty.  Rows without a conversation belong to none and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = talk.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("at"), digest.alias("turn"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")).where("c is not null")
    order = [F.asc_nulls_first("at"), F.asc("turn")]
    ranged = stored(rows.repartitionByRange(F.asc("c"), *order).withColumn("part", F.spark_partition_id()), "turns")
    inside = F.row_number().over(Window.partitionBy("c", "part").orderBy(*order))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = ranged.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n")).select("c", "part", before.alias("before"))
    continued = counts.where("before > 0")  # one a range at most: its first conversation
    placed = ranged.select("c", "part", "turn", "words", inside.cast("long").alias("inside")).join(F.broadcast(continued), ["c", "part"], "left")
    return placed.select("c", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("place"), "turn", "words")


def rejoined(turns: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the head of the first of their block: (c, place, turn, words), and all c with their length.

    Conversation c takes the first h turns of conversation c - c % block, h being the unsigned
    crc32 of c in decimal, modulo `most`, and goes on with its own turns after its first h.  Fewer or
    no turns there are fewer or no turns here; a conversation may be left with none.  The remainder of a
    negative c is negative, as in SQL."""
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % F.lit(most)).cast("long")
    base = F.col("c") - F.col("c") % F.lit(block)
    sizes = stored(turns.groupBy("c").agg(F.max("place").alias("n")), "sizes")
    heads = sizes.select(F.col("c").alias("base"), F.col("n").alias("there"))
    wanted = sizes.select("c", base.alias("base"), h.alias("h")).where("c <> base and h > 0")
    lent = wanted.join(turns.where((F.col("c") == base) & (F.col("place") < most)).select(F.col("c").alias("base"), "place", "turn", "words"), "base").where("place <= h").select("c", "place", "turn", "words")
    short = wanted.join(heads, "base", "left").select("c", (F.col("h") - F.least("h", F.coalesce("there", F.lit(0)))).alias("missing")).where("missing > 0")
    own = turns.where((F.col("c") == base) | (F.col("place") > h)).join(short, "c", "left").select("c", (F.col("place") - F.coalesce("missing", F.lit(0))).alias("place"), "turn", "words")
    whole = stored(own.unionByName(lent), "rejoined")
    lengths = whole.groupBy("c").agg(F.max("place").alias("n"))
    return whole, sizes.select("c").join(lengths, "c", "left").select("c", F.coalesce("n", F.lit(0)).alias("n"))


def dense(keys: DataFrame, files: int) -> DataFrame:
    """Distinct rows with a name from 0 on, without gaps: numbered in their partitions, moved by the rows of the ones before."""
    marked = stored(keys.distinct().withColumn("mark", F.monotonically_increasing_id()), "names", files)
    part = F.shiftright("mark", 33)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each partition
    name = F.col("before") + F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn("part", part).join(F.broadcast(starts), "part").select(*keys.columns, name.alias("name"))


def named(rows: DataFrame, keys: list[str], kept: list[str], n: int) -> DataFrame:
    """rows (at most some n) with the dense name of their keys, stored."""
    names = dense(rows.select(*keys), files_for(n))
    return stored(rows.join(names, keys).select(*kept, "name"), "named", files_for(n))


def prefix_names(turns: DataFrame, longest: int, n: int) -> DataFrame:
    """(c, depth, name, words): each prefix of each conversation, words of its last turn; equal prefixes have equal names.

    turns: n rows (c, place, turn, words), places 1 to at most `longest`."""
    blocks = named(turns.withColumn("start", F.col("place") - 1), ["turn"], ["c", "start", "words"], n)
    ends, k = [], 0
    while True:
        size = 1 << k
        whole = blocks.select("c", (F.col("start") + size).alias("depth"), "start", F.col("name").alias("right"), "words")
        ends.append(whole.where(F.col("start") % (2 * size) == 0))  # the block of the lowest bit of depth
        k, size = k + 1, 2 * size
        if size > longest:
            break
        first = F.col("start") % size == 0
        halves = blocks.groupBy("c", F.expr(f"start - start % {size}").alias("at")).agg(
            F.max(F.when(first, F.col("name"))).alias("left"), F.max(F.when(~first, F.col("name"))).alias("right"), F.max(F.when(~first, F.col("words"))).alias("words")
        )
        blocks = named(halves.where("left is not null and right is not null").withColumnRenamed("at", "start"), ["left", "right"], ["c", "start", "words"], n >> k)
    by_end = ends[0]
    for more in ends[1:]:
        by_end = by_end.unionByName(more)
    found = by_end.where("start = 0").select("c", "depth", F.col("right").alias("name"), "words")
    rounds = [found]
    for bits in range(2, longest.bit_length() + 1):
        here = by_end.where(F.bit_count("depth") == bits)
        left = rounds[-1].select("c", F.col("depth").alias("start"), F.col("name").alias("left"))
        rows = here.join(left, ["c", "start"])
        rounds.append(named(rows, ["depth", "left", "right"], ["c", "depth", "words"], n).select("c", "depth", "name", "words"))
    for more in rounds[1:]:
        found = found.unionByName(more)
    return found


def later_sums(rows: DataFrame, values: list[str], deepest: int, chunk: int) -> DataFrame:
    """rows (c, depth, ...) with each value summed over the row and the deeper rows of its conversation."""
    rows = rows.withColumn("chunk", F.expr(f"depth div {chunk}"))
    down = Window.partitionBy("c", "chunk").orderBy(F.desc("depth"))
    inside = rows.withColumns({v: F.sum(v).over(down) for v in values})
    if deepest < chunk:
        return inside.drop("chunk")
    beyond = Window.partitionBy("c").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("c", "chunk").agg(*[F.sum(v).alias(v) for v in values])
    deeper = totals.select("c", "chunk", *[F.sum(v).over(beyond).alias(f"deeper_{v}") for v in values])
    both = inside.join(deeper, ["c", "chunk"], "left")
    return both.select(*[(F.col(x) + F.coalesce(f"deeper_{x}", F.lit(0))).alias(x) if x in values else F.col(x) for x in rows.columns if x != "chunk"])


def packed_ends(limit: int):
    """mapInArrow body over rows sorted by (owner, depth, c): ids of one node joined by commas, at most `limit` in a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, ids, number, whole = (-1, -1), 0, [], 0, True
        done: list[tuple] = []  # owner, depth, first id, ids, whole

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["owner", "depth", "first", "ids", "whole"])

        for batch in batches:
            owner, depth, c = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(owner)], strict=True):
                if a == b:
                    continue
                key = (int(owner[a]), int(depth[a]))
                if key != at:
                    if ids:  # the first of a range may go on from the one before
                        done.append((*at, first, ",".join(map(str, ids)), number > 1 and whole))
                    at, ids, number, whole = key, [], number + 1, True
                for k in range(a, b, limit):
                    part = c[k : min(k + limit, b)].tolist()
                    if not ids:
                        first = part[0]
                    ids += part
                    if len(ids) >= limit:
                        done.append((*at, first, ",".join(map(str, ids)), False))
                        ids, whole = [], False
            if done:
                yield batch_of(done)
                done = []
        if ids:
            yield batch_of([(*at, first, ",".join(map(str, ids)), False)])

    return run


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over pieces sorted by (owner, depth, first): one hash for each node, fed piece by piece."""
    at, hashed = None, None
    for batch in batches:
        done = []
        for owner, depth, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (owner, depth) != at:
                if at:
                    done.append((*at, hashed.hexdigest()))
                at, hashed = (owner, depth), hashlib.sha256(ids.encode())
            else:
                hashed.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done, strict=True)], ["owner", "depth", "ends_sha256"])
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([hashed.hexdigest()])], ["owner", "depth", "ends_sha256"])


def ends_hashes(ends: DataFrame, limit: int = PIECE) -> DataFrame:
    """(owner, depth, ends_sha256) of rows (owner, depth, c): SHA-256 of each node's ids, ascending, joined by commas.

    Ids are sorted in ranges, so that the ids of one node are spread.  A node that lies inside one
    range is done there; pieces of the others are hashed in order, without being held."""
    keys = ["owner", "depth"]
    ranged = ends.select(*keys, "c").repartitionByRange(*keys, "c").sortWithinPartitions(*keys, "c")
    pieces = stored(ranged.mapInArrow(packed_ends(limit), "owner long, depth long, first long, ids string, whole boolean"), "ends")
    inside = pieces.where("whole").select(*keys, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    open_ = pieces.where("not whole").repartition(*keys).sortWithinPartitions(*keys, "first").select(*keys, "ids")
    return inside.unionByName(open_.mapInArrow(chained, "owner long, depth long, ends_sha256 string"))


def trie(turns: DataFrame, conversations: DataFrame, chunk: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """One row per distinct prefix: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (c, place, turn, words), stored; conversations: (c, n), each with its number of turns,
    0 allowed.  The root has depth 0 and no parent.  n_leaves counts childless nodes of the
    subtree, its top included; saved_tokens adds up (n_convs - 1) times the words of the last turn over it;
    ends_sha256 hashes the ids of the conversations that end at the node.  No conversations, no
    nodes."""
    small_arrow_batches(turns.sparkSession)
    conversations = stored(conversations, "conversations")
    n_convs, root, longest, n = conversations.agg(F.count("c"), F.min("c"), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not n_convs:
        return turns.sparkSession.createDataFrame([], schema)
    top = conversations.select("c", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("owner"), F.lit(n_convs).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    if longest:
        prefixes = prefix_names(turns, longest, n)
        shared = prefixes.groupBy("depth", "name").agg(F.min("c").alias("owner"), F.count(F.lit(1)).alias("n_convs"))
        below = prefixes.join(shared, ["depth", "name"]).select("c", "depth", "owner", "n_convs", "words")
        top = top.unionByName(below)
    members = stored(top, "members", files_for(n + n_convs))
    owned = members.where("c = owner")
    above = members.select("c", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    nodes = stored(owned.join(above, ["c", "depth"], "left").select("c", "depth", "parent", "n_convs"), "nodes", files_for(n))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("c"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, ["c", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes", files_for(n))
    zero = F.lit(0).cast("long")
    adds = members.where("c <> owner").select("c", "depth", "owner", F.col("words").alias("saved"), zero.alias("leaves"))
    adds = adds.unionByName(nodes.select("c", "depth", F.col("c").alias("owner"), zero.alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves")))
    sums = later_sums(adds, ["saved", "leaves"], longest, chunk).groupBy("owner", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    ends = conversations.select("c", F.col("n").alias("depth")).join(members, ["c", "depth"])
    hashes = ends_hashes(ends, piece)
    whole = nodes.withColumnRenamed("c", "owner").join(sums, ["owner", "depth"]).join(hashes, ["owner", "depth"], "left")
    return whole.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(talk: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int | None = None, most: int = 4) -> DataFrame:
    """The trie of a table of turns, as in trie(); with `block`, of the conversations as rejoined() rebuilds them.

    Extra columns do not matter; an empty table gives an empty result."""
    with temporary(talk.sparkSession):
        turns = stored(turns_in_order(talk, conv_col, turn_col, role_col, text_col), "turns")
        if block is None:
            lengths = turns.groupBy("c").agg(F.max("place").alias("n"))
        else:
            turns, lengths = rejoined(turns, block, most)
        return stored(trie(turns, lengths), "trie", outlives=1)
