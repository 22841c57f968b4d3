"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: 64-bit majority vote over XXH64 of word shingles, in Arrow batches.

Links (at most `bits` differing bits) are found without comparing all pairs:
  * equal fingerprints are one node (grouped with partial aggregation);
  * each node is routed by the bit blocks that two linked fingerprints must share
    (pigeonhole: `bits` differences spoil at most `bits` of bits + k blocks, so k
    agree), so each task holds nodes that agree on some k blocks; k is 1 for up to
    some 2 million nodes and grows with their number;
  * in a task the nodes of a key are sorted by Gray rank and put under a tree.  A
    tree node stores only the bits that all its fingerprints share and its parent
    does not (the factored pattern); a search adds up differences on the way down
    and leaves a whole group once they exceed `bits`, or once every member is known
    to be connected with the query;
  * a task returns one pointer per fingerprint that it could connect, never pairs.
Pointers are then merged by star contraction in stored rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ID, TEXT, files_for, id_text, slices, small_arrow_batches, stored, temporary, text_buffers

SHINGLE, BITS, SEED = 4, 4, 42
#: Nodes that share a key on average, at most; and nodes of one key that a task takes together.
GROUP, KEY_ROWS = 256, 8192
#: Most blocks that a key joins.
MOST_SHARED = 4
#: Rows that a task looks at together, rows of a task on average, and large keys that are broadcast at most (8 bytes each).
STEP_ROWS, TASK_ROWS, BROADCAST_KEYS = 1 << 16, 2_000_000, 1_000_000
FANOUT = 8
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Byte value to eight lanes of a 64-bit word, lane i holding bit i.
LANES = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) @ (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8)))


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of every run of `size` words, repeats included; of all words if fewer."""
    words = text.translate(LOWER).split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes: a bit is 1 if set in over half."""
    out = np.zeros(len(counts), np.uint64)
    if not len(hashes):
        return out
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    # sub-groups of at most 255 hashes, so that byte lanes cannot overflow
    pieces = -(-counts[full] // 255)
    first = np.cumsum(pieces) - pieces
    sub = np.repeat(starts - 255 * first, pieces) + 255 * np.arange(pieces.sum())
    votes = np.empty((len(full), 64), np.int64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(LANES[octets[:, k]], sub)
        votes[:, 8 * k : 8 * k + 8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    bits = (2 * votes > counts[full][:, None]).astype(np.uint64)
    out[full] = bits @ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    return out


def fingerprint_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, ends = text_buffers(batch.column(1))
            raw = data[ends[0] : ends[-1]].tobytes()
            per_doc = [shingle_hashes(raw[a:b], size) for a, b in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True)]
            counts = np.fromiter(map(len, per_doc), np.int64, len(per_doc))
            flat = np.fromiter((h for hs in per_doc for h in hs), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(majority(flat, counts).view(np.int64))], [ID, "text_xxh64", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Columns __id, text_xxh64 (of the text as it stands) and fp (the 64 bits as a signed long);
    null texts have no words, fingerprint 0."""
    small_arrow_batches(docs.sparkSession)
    rows = id_text(docs, id_col, text_col).withColumn("text_xxh64", F.xxhash64(TEXT))
    schema = T.StructType([rows.schema[0], T.StructField("text_xxh64", T.LongType()), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(fingerprint_batches(size), schema)


# ---- the index ----------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayForest:
    """One tree per key over codes sorted by (key, Gray rank)."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), keys))
        self.order, self.codes, keys = order, codes[order], keys[order]
        self.levels: list[dict[str, np.ndarray]] = []
        low = high = self.codes
        while True:
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(keys)))
            if self.levels and len(heads) == len(keys):
                break
            place = np.arange(len(keys)) - np.repeat(heads, sizes)
            starts = np.flatnonzero(place % FANOUT == 0)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            self.levels.append({"start": starts, "end": np.append(starts[1:], len(keys)), "fixed": ~(low ^ high), "pattern": low})
            keys = keys[starts]
        #: root of each code's tree, in the top level
        top = np.arange(len(self.codes))
        for level in self.levels:
            top = np.searchsorted(level["start"], top, side="right") - 1
        self.root = top
        # a child keeps only what its parent has not fixed already
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            below["rest"] = below["fixed"] & ~np.repeat(above["fixed"], above["end"] - above["start"])
        self.levels[-1]["rest"] = self.levels[-1]["fixed"]
        self.leaf_rest = ~np.repeat(self.levels[0]["fixed"], self.levels[0]["end"] - self.levels[0]["start"])

    def near(self, queries: np.ndarray, bits: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, entry) with entry after query, at most `bits` apart and labelled apart."""
        q, node = queries, self.root[queries]
        gone = (np.bitwise_count((self.codes[q] ^ self.levels[-1]["pattern"][node]) & self.levels[-1]["rest"][node])).astype(np.int16)
        uniform = self.uniform(labels)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            keep = (gone <= bits) & (uniform[depth][node] != labels[q]) & (self.last(depth)[node] > q)
            q, node, gone = q[keep], node[keep], gone[keep]
            counts = level["end"][node] - level["start"][node]
            child = np.repeat(level["start"][node] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            q, gone = np.repeat(q, counts), np.repeat(gone, counts)
            if depth:
                below = self.levels[depth - 1]
                pattern, rest = below["pattern"][child], below["rest"][child]
            else:
                pattern, rest = self.codes[child], self.leaf_rest[child]
            gone = gone + np.bitwise_count((self.codes[q] ^ pattern) & rest).astype(np.int16)
            node = child
        keep = (gone <= bits) & (node > q)
        return q[keep], node[keep]

    def last(self, depth: int) -> np.ndarray:
        """Last entry below each node of a level."""
        if "last" not in self.levels[depth]:
            ends = self.levels[depth]["end"] - 1
            self.levels[depth]["last"] = ends if depth == 0 else self.last(depth - 1)[ends]
        return self.levels[depth]["last"]

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """The label that all entries of a node share, else -1."""
        out, least, most = [], labels, labels
        for level in self.levels:
            least, most = np.minimum.reduceat(least, level["start"]), np.maximum.reduceat(most, level["start"])
            out.append(np.where(least == most, least, -1))
        return out


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the sets of a[i] and b[i]; every entry ends at its smallest member."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def connect(keys: np.ndarray, codes: np.ndarray, bits: int = BITS, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(code, pointer) for each distinct code linked, directly or not, to a smaller one of its keys."""
    _, at, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    busy = sizes[at] > 1
    keys, codes = keys[busy], codes[busy]
    if not len(codes):
        return codes, codes
    forest = GrayForest(keys, codes)
    distinct, ids = np.unique(forest.codes, return_inverse=True)
    parent = np.arange(len(distinct))
    # a small group that varies in few bits is linked throughout
    leaf = forest.levels[0]
    tight = np.flatnonzero((np.bitwise_count(~leaf["fixed"]) <= bits) & (leaf["end"] - leaf["start"] > 1))
    if len(tight):
        counts = leaf["end"][tight] - leaf["start"][tight]
        members = np.repeat(leaf["start"][tight] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        parent = merge(parent, ids[np.repeat(leaf["start"][tight], counts)], ids[members])
    at, step = 0, min(block, 512)
    while at < len(ids):
        queries = np.arange(at, min(at + step, len(ids)))
        q, e = forest.near(queries, bits, parent[ids])
        parent = merge(parent, ids[q], ids[e])
        at, step = at + step, min(block, step * 2 if len(q) < 1 << 20 else max(64, step // 2))
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return distinct[moved], distinct[parent[moved]]


def shared_blocks(nodes: int, bits: int = BITS) -> int:
    """Blocks that a key joins: the fewest with which no more than GROUP nodes share a key on average."""
    return next((k for k in range(1, MOST_SHARED) if nodes <= GROUP * 2 ** (64 * k / (bits + k))), MOST_SHARED)


def block_keys(fp: Column, bits: int, shared: int) -> Column:
    """Array of routing keys: `shared` of bits + `shared` blocks of the 64 bits, with the choice's number."""
    cuts = np.linspace(0, 64, bits + shared + 1).round().astype(int).tolist()
    masks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    joined = [sum(chosen) for chosen in combinations(masks, shared)]
    signed = [m - (1 << 64) if m >> 63 else m for m in joined]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])


def connect_partition(bits: int):
    """mapInArrow body over (key, fp) rows sorted by key: whole keys are taken STEP_ROWS rows at a time."""

    def connected(keys: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        code, pointer = connect(keys, codes.view(np.uint64), bits)
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(pointer.view(np.int64))], ["x", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows >= STEP_ROWS:
                keys, codes = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield connected(keys[:cut], codes[:cut])
                held, rows = [(keys[cut:], codes[cut:])], len(keys) - cut
        if rows:
            yield connected(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def pointers(nodes: DataFrame, bits: int = BITS, key_rows: int = KEY_ROWS, shared: int | None = None) -> DataFrame:
    """(x, p) pointers that connect exactly the fingerprints linked through steps of at most `bits`.

    Keys are counted first.  Those of up to key_rows nodes are shuffled to their tasks, once, and
    taken key by key.  The nodes of larger keys are routed again, by keys that join one more block
    (two linked nodes share those as well); what is still large with MOST_SHARED blocks is cut into
    chunks, and a chunk meets each other chunk of its key in a key of its own."""
    spark = nodes.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, count = nodes.select("fp"), nodes.count()
    shared = shared or shared_blocks(count, bits)
    dealt = None
    while True:
        routed = stored(rows.select("fp", F.explode(block_keys(F.col("fp"), bits, shared)).alias("key")), "routed")
        large = stored(routed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > key_rows), "large", files_for(count))
        n_large = large.count()  # at most 1 / key_rows of the rows routed
        mark = (lambda t: F.broadcast(t)) if n_large <= BROADCAST_KEYS else (lambda t: t)
        small = routed.join(mark(large.select("key")), "key", "left_anti") if n_large else routed
        dealt = small.select("key", "fp") if dealt is None else dealt.unionByName(small.select("key", "fp"))
        if not n_large:
            break
        hot = routed.join(mark(large), "key")
        if shared >= MOST_SHARED:
            chunked = hot.withColumn("chunks", F.ceil(F.col("n") / F.lit(key_rows)).cast("int"))
            mine, other = F.pmod(F.xxhash64("fp"), F.col("chunks")), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
            pairs = chunked.select("key", "fp", mine.alias("c"), other.alias("d"))
            dealt = dealt.unionByName(pairs.select(F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")).alias("key"), "fp"))
            break
        rows, shared = stored(hot.select("fp").distinct(), "hot"), shared + 1
        count = rows.count()
    width = max(least, 1, routed.count() // TASK_ROWS)
    return dealt.repartition(width, "key").sortWithinPartitions("key").mapInArrow(connect_partition(bits), "x long, p long")


def roots(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(x, root) with the smallest unsigned fingerprint of x's component, for every x that is not a root.

    Each round: x keeps its least pointer and its other pointers are linked to that
    one; then pointers jump one level.  Every step is a join or a grouped minimum
    over a stored table.  Rounds go on until each x has one pointer, to a root: pointers
    only ever fall, so they end.  files: most files of the first table of edges."""
    flip = F.lit(-(1 << 63))
    edges = stored(edges.select(F.col("x").bitwiseXOR(flip).alias("x"), F.col("p").bitwiseXOR(flip).alias("p")).distinct(), "edges", files)
    while True:
        files = files_for(edges.count())
        least = stored(edges.groupBy("x").agg(F.min("p").alias("m"), F.count(F.lit(1)).alias("n")), "least", files)
        many = least.where("n > 1").select("x", "m")
        side = edges.join(many, "x").where("p <> m").select(F.col("p").alias("x"), F.col("m").alias("p"))
        up = least.select(F.col("x").alias("p"), F.col("m").alias("up"))
        jumped = least.select("x", F.col("m").alias("p")).join(up, "p", "left").select("x", F.coalesce("up", "p").alias("p"), F.col("up").isNotNull().alias("moved"))
        step = stored(jumped.unionByName(side.withColumn("moved", F.lit(True))), "step", files)
        if step.where("moved").isEmpty():
            return step.select(F.col("x").bitwiseXOR(flip).alias("x"), F.col("p").bitwiseXOR(flip).alias("root"))
        edges = stored(step.select("x", "p").distinct(), "edges", files)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, kept, text_xxh64.

    component_id is the smallest id reachable over links of at most `bits` differing
    bits, the row's own included; null ids are never chosen unless a component has no
    other.  kept marks the component's row with the smallest id and, of several with that
    id, the smallest text_xxh64 (a hash of the text as it stands, null as empty): one row,
    but for rows that repeat both id and text, which are all marked.  Null, empty and
    word-free texts have fingerprint zero and are linked like any other.  Repeated rows
    share a component.  An empty table gives an empty result.
    """
    with temporary(docs.sparkSession):
        rows = stored(fingerprints(docs, id_col, text_col, size), "fingerprints", outlives=1)
        files = files_for(rows.count())
        nodes = stored(rows.groupBy("fp").agg(F.min(F.struct(F.col(ID).isNull().alias("none"), F.col(ID).alias("id"), F.col("text_xxh64").alias("text"))).alias("rep")), "nodes", files)
        root = roots(pointers(nodes.select("fp"), bits), files)
        rooted = nodes.join(root, nodes.fp == root.x, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
        names = rooted.groupBy("root").agg(F.min("rep").alias("rep"))
        named = stored(rooted.select("fp", "root").join(names, "root").select("fp", F.col("rep.id").alias("component_id"), F.col("rep.text").alias("its_text")), "named", files, outlives=1)
    kept = F.col(ID).eqNullSafe(F.col("component_id")) & (F.col("text_xxh64") == F.col("its_text"))
    return rows.join(named, "fp").select(F.col(ID).alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", kept.alias("kept"), "text_xxh64")
