"""Benchmark decontamination with suffix arrays over the training text.

Each task turns its documents, a shard at a time, into word numbers of the
benchmark's vocabulary and builds a suffix array over the stretches of known words
that are long enough to hold a window (no other suffix can match).  Every benchmark
window is binary-searched in each shard; matches give hit words and items, and each
match is followed as far as it goes: the longest of a document, or of an item, with its
place.  Documents are never shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import ID, TEXT, attach, id_text, scratch, slices, small_arrow_batches, text_buffers
from .wordhash import LOWER, WORD_BYTES, word_hashes

WINDOW = 13
#: Benchmark text that is broadcast at once; a larger benchmark is taken in several blocks.
BLOCK_BYTES = 32 << 20
#: Text of one shard: the benchmark is searched once in each, so larger shards mean less work.
SHARD_BYTES = 4 << 20
SLOTS = 18


@dataclass
class Tests:
    """One block of the benchmark, as numbers of its own vocabulary (from 1)."""

    items: list  # ids
    vocabulary: np.ndarray  # sorted word hashes
    words: np.ndarray  # all items, each followed by 0
    start: np.ndarray  # first word of each item
    length: np.ndarray  # words of each item
    window_at: np.ndarray  # a place of each distinct window in words
    window_len: np.ndarray
    window_places: np.ndarray  # all places of the windows, those of one after another
    window_first: np.ndarray  # where each window's places begin; one more at the end
    owner: np.ndarray  # item of each entry of words
    slots: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str], window: int) -> Tests:
        array = pa.array(texts, pa.string())
        data, ends = text_buffers(array)
        hashes, owner = word_hashes(data, ends, WORD_BYTES, LOWER)
        vocabulary = np.unique(hashes)
        length = np.bincount(owner, minlength=len(ids)).astype(np.int64)
        start = np.cumsum(length + 1) - length - 1
        words = np.zeros(int((length + 1).sum()), np.int64)
        words[np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = np.searchsorted(vocabulary, hashes) + 1
        distinct: dict[bytes, int] = {}
        place, number, size = [], [], []
        for s, n in zip(start.tolist(), length.tolist(), strict=True):
            width = min(window, n)
            for w in range(s, s + n - width + 1) if n else ():
                k = distinct.setdefault(words[w : w + width].tobytes(), len(distinct))
                place.append(w)
                number.append(k)
                if k == len(size):
                    size.append(width)
        order = np.argsort(np.array(number, np.int64), kind="stable")
        first = np.searchsorted(np.array(number, np.int64)[order], np.arange(len(size) + 1))
        slots = np.zeros(1 << SLOTS, np.int32)
        slot = (vocabulary >> np.uint64(64 - SLOTS)).astype(np.int64)
        times = np.bincount(slot, minlength=1 << SLOTS)
        slots[slot] = np.arange(1, len(vocabulary) + 1)
        slots[times > 1] = -1
        place = np.array(place, np.int64)[order]
        owner = np.repeat(np.arange(len(ids)), length + 1) if len(ids) else np.zeros(0, np.int64)
        return cls(ids, vocabulary, words, start, length, place[first[:-1]], np.array(size, np.int64), place, first, owner, slots)

    @property
    def index(self) -> Shard:
        """Suffix array over the items themselves, made when first asked for."""
        if not hasattr(self, "_index"):
            self._index = Shard(self.words, self.owner, 1, int(self.length.max(initial=1)))
        return self._index

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, 0 if unknown."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        found = self.slots[(hashes >> np.uint64(64 - SLOTS)).view(np.int64)]
        one = np.flatnonzero(found > 0)
        found[one[self.vocabulary[found[one] - 1] != hashes[one]]] = 0
        many = np.flatnonzero(found < 0)
        if len(many):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[many]), len(self.vocabulary) - 1)
            found[many] = np.where(self.vocabulary[at] == hashes[many], at + 1, 0)
        return found


class Shard:
    """Suffix array over the stretches of known words of some documents."""

    def __init__(self, numbers: np.ndarray, owner: np.ndarray, least: int, depth: int):
        known = numbers > 0
        joined = known[1:] & known[:-1] & (owner[1:] == owner[:-1])
        heads = np.flatnonzero(known & np.concatenate([[True], ~joined]))
        tails = np.flatnonzero(known & np.concatenate([~joined, [True]])) + 1
        busy = tails - heads >= least
        heads, sizes = heads[busy], (tails - heads)[busy]
        shift = np.cumsum(sizes + 1) - sizes - 1
        spread = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        #: word numbers, a 0 after each stretch; where each came from
        self.words = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
        inside = np.repeat(shift, sizes) + spread
        self.words[inside] = numbers[np.repeat(heads, sizes) + spread]
        self.origin = np.full(len(self.words), -1, np.int64)
        self.origin[inside] = np.repeat(heads, sizes) + spread
        # prefix doubling; a 0 ends a suffix, so ranks stop mattering beyond it
        rank, reach = self.words.copy(), 1
        n = len(rank)
        while reach < depth and n:
            ahead = np.zeros(n, np.int64)
            ahead[: n - reach] = rank[reach:] if reach < n else 0
            ahead[rank == 0] = 0
            _, rank2 = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)
            rank2[self.words == 0] = 0
            if (rank2.max() == rank.max()) and reach > 1:
                break
            rank, reach = rank2, reach * 2
        order = np.argsort(rank, kind="stable")
        self.suffixes = order[self.words[order] > 0]

    def bound(self, tests: np.ndarray, at: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of the test words [at, at + length): first suffix not before (or after) them."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            suffix = self.suffixes[middle]
            sign = np.zeros(len(open_), np.int64)  # of suffix against test
            left, k = np.arange(len(open_)), 0
            while len(left):
                a, b = self.words[suffix[left] + k], tests[at[open_[left]] + k]
                sign[left] = np.sign(a - b)
                k += 1
                left = left[(a == b) & (length[open_[left]] > k)]
            before = (sign < 0) | (upper & (sign == 0))
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]

    def common(self, tests: np.ndarray, at: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Words that each test suffix shares with a suffix-array entry."""
        out = np.zeros(len(at), np.int64)
        left = np.flatnonzero((entry >= 0) & (entry < len(self.suffixes)))
        while len(left):
            a, b = self.words[self.suffixes[entry[left]] + out[left]], tests[at[left] + out[left]]
            left = left[(a == b) & (b > 0)]
            out[left] += 1
        return out


def spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All of starts[i] + 0..lengths[i] - 1."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


@dataclass
class Text:
    """The words of some documents, as hashes."""

    hashes: np.ndarray
    owner: np.ndarray
    first: np.ndarray  # where each document's words begin; one more at the end

    @classmethod
    def of(cls, text: pa.Array) -> Text:
        data, ends = text_buffers(text)
        hashes, owner = word_hashes(data, ends, WORD_BYTES, LOWER)
        return cls(hashes, owner, np.searchsorted(owner, np.arange(len(text) + 1)))


@dataclass
class Found:
    """What one shard holds of one block of tests."""

    hit: np.ndarray  # whether each word lies in a window's occurrence
    items: dict[int, list]  # documents with occurrences: ids of the items
    at: np.ndarray  # where occurrences of windows begin, and how many words they have
    size: np.ndarray


def search(text: Text, tests: Tests) -> Found:
    """Find every window of the tests that can occur: all its words must be in the shard."""
    nothing = Found(np.zeros(len(text.hashes), bool), {}, np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(tests.window_at) or not len(text.hashes):
        return nothing
    shard = Shard(tests.numbers(text.hashes), text.owner, int(tests.window_len.min()), int(tests.window_len.max()))
    if not len(shard.suffixes):
        return nothing
    lacks = np.ones(len(tests.vocabulary) + 1, np.int64)
    lacks[shard.words] = 0
    missing = np.concatenate([[0], np.cumsum(lacks[tests.words])])
    asked = np.flatnonzero(missing[tests.window_at + tests.window_len] == missing[tests.window_at])
    at, length = tests.window_at[asked], tests.window_len[asked]
    low, high = (shard.bound(tests.words, at, length, upper) for upper in (False, True))
    some = np.flatnonzero(high > low)
    if not len(some):
        return nothing
    count, window = (high - low)[some], asked[some]
    entry = shard.suffixes[spans(count, low[some])]
    place = shard.origin[entry]
    width = np.repeat(tests.window_len[window], count)
    change = np.zeros(len(text.hashes) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + width, -1)
    pairs = np.unique(text.owner[place] * len(tests.window_at) + np.repeat(window, count))
    seen: dict[int, set] = {}
    for doc, w in zip(*(x.tolist() for x in np.divmod(pairs, len(tests.window_at))), strict=True):
        seen.setdefault(doc, set()).update(tests.owner[tests.window_places[tests.window_first[w] : tests.window_first[w + 1]]].tolist())
    items = {doc: [tests.items[i] for i in sorted(s)] for doc, s in seen.items()}
    return Found(np.cumsum(change[:-1]) > 0, items, place, width)


def longest_by_document(tests: Tests, text: Text, at: np.ndarray, size: np.ndarray) -> dict[int, tuple]:
    """(words, document word, item) of each document's longest match with one of these items that
    holds a window's occurrence; at, size: the occurrences of the windows of all items.

    A match that begins one word earlier and holds the occurrence holds the match from here, so the
    search goes to the left of each occurrence only while it succeeds.  Ties go to the earliest place
    in the document, then to the first item."""
    index = tests.index
    if not len(at) or not len(index.suffixes):
        return {}
    docs = np.unique(text.owner[at])
    long = text.first[docs + 1] - text.first[docs]
    begin = np.cumsum(long + 1) - long - 1  # of each document in words, a 0 after each
    words = np.zeros(int((long + 1).sum()), np.int64)
    words[spans(long, begin)] = tests.numbers(text.hashes[spans(long, text.first[docs])])

    def moved(place: np.ndarray) -> np.ndarray:
        k = np.searchsorted(docs, text.owner[place])
        return place - text.first[docs[k]] + begin[k]

    start = moved(at)
    need = np.full(len(words), len(words) + 1)  # where the occurrence that ends first, of those from here on, ends
    np.minimum.at(need, start, start + size)
    need = np.minimum.accumulate(need[::-1])[::-1]
    stops = np.flatnonzero(words == 0)
    tried, places, sizes = np.zeros(len(words), bool), [], []
    here = np.unique(start)
    while len(here):
        tried[here] = True
        rest = stops[np.searchsorted(stops, here)] - here
        low = index.bound(words, here, rest, False)
        found = np.maximum(index.common(words, here, low - 1), index.common(words, here, low))
        holds = here + found >= need[here]
        places.append(here[holds])
        sizes.append(found[holds])
        here = here[holds] - 1
        here = here[here >= 0]
        here = here[(words[here] > 0) & ~tried[here]]
    place, found = np.concatenate(places), np.concatenate(sizes)
    k = np.searchsorted(begin, place, side="right") - 1
    best = np.lexsort((place, -found, k))
    best = best[np.concatenate([[True], k[best][1:] != k[best][:-1]])[: len(best)]]
    if not len(best):
        return {}
    k, found, place = k[best], found[best], place[best]
    low, high = (index.bound(words, place, found, upper) for upper in (False, True))
    # the first of all places where the items have these words
    first = np.minimum.reduceat(np.append(index.suffixes, len(tests.words)), np.stack([low, high], 1).reshape(-1))[::2]
    item = tests.owner[index.origin[first]]
    return {d: (n, p, tests.items[i]) for d, n, p, i in zip(docs[k].tolist(), found.tolist(), (place - begin[k]).tolist(), item.tolist(), strict=True)}


def longest_by_item(shard: Shard, tests: Tests, text: Text, rank: np.ndarray) -> list[tuple]:
    """(item, words, item word, row, document word) of each item's longest match here.

    Ties go to the earliest word of the item, then to the document of the least rank, then to its earliest word."""
    inside = np.flatnonzero(tests.words > 0)
    item = tests.owner[inside]
    rest = tests.start[item] + tests.length[item] - inside
    at = shard.bound(tests.words, inside, rest, False)
    before, here = shard.common(tests.words, inside, at - 1), shard.common(tests.words, inside, at)
    size = np.maximum(before, here)
    best = np.lexsort((inside, -size, item))
    best = best[np.concatenate([[True], item[best][1:] != item[best][:-1]])]
    best = best[size[best] > 0]
    if not len(best):
        return []
    # of all places in the documents that have these words, the first by rank and word
    low, high = (shard.bound(tests.words, inside[best], size[best], upper) for upper in (False, True))
    place = shard.origin[shard.suffixes]
    doc, wide = text.owner[place], len(text.hashes) + 1
    order = rank[doc] * wide + place - text.first[doc]
    chosen, word = np.divmod(np.minimum.reduceat(np.append(order, 0), np.stack([low, high], 1).reshape(-1))[::2], wide)
    row = np.zeros(int(rank.max()) + 1, np.int64)
    row[rank] = np.arange(len(rank))
    return list(zip(item[best].tolist(), size[best].tolist(), (inside - tests.start[item])[best].tolist(), row[chosen].tolist(), word.tolist(), strict=True))


# ---- the benchmark in blocks -------------------------------------------------------


class Blocks:
    """The benchmark in blocks of about block_bytes, dealt by a hash of the item id.

    A single block is broadcast.  Of several, each is gathered, written to the shared folder
    and forgotten; a worker reads one at a time for each shard, so no process ever holds more
    than one block."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
        spark = benchmark.sparkSession
        items = id_text(benchmark, item_col, text_col)
        size = items.agg(F.sum(F.octet_length(TEXT) + 64)).first()[0] or 0
        count = max(1, -(-size // block_bytes))
        self.shared, self.paths = None, []
        folder = scratch(spark, "benchmark") if count > 1 else ""
        for k in range(count):
            block = items if count == 1 else items.where(F.pmod(F.xxhash64(ID), F.lit(count)) == k)
            rows = block.orderBy(ID, TEXT).collect()
            tests = Tests.of([r[0] for r in rows], [r[1] for r in rows], window)
            if count == 1:
                self.shared = spark.sparkContext.broadcast(tests)
            else:
                self.paths.append(f"{folder}/{k}")
                fs, path = pafs.FileSystem.from_uri(self.paths[-1])
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write(pickle.dumps(tests))

    @property
    def shard_bytes(self) -> int:
        """Text of one shard; more where each shard has several blocks to read."""
        return SHARD_BYTES * min(4, max(1, len(self.paths)))

    def __iter__(self) -> Iterator[Tests]:
        if self.shared is not None:
            yield self.shared.value
        for uri in self.paths:
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_stream(path) as source:
                yield pickle.loads(source.read())


def hit_spans(hit: np.ndarray) -> list[dict]:
    """Runs of hit words as spans."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with n_words, n_hit, spans, item_ids, longest_words, longest_at,
    longest_item and contaminated, row by row, without a shuffle.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z.
    A window is `window` consecutive words of an item, or a whole shorter item; spans
    are the document words (start, end exclusive) inside any window's occurrence.
    longest_words is the length of the longest run of words that the document shares with any item
    and that holds an occurrence of any item's window, longest_at the document word where it begins
    and longest_item its item (0, null and null without any; ties go to the earliest word, then to the
    smallest item id, null first).
    A document is contaminated if n_hit > 0 and share * n_hit >= n_words.  Null and
    empty texts and items have no words and never match.  Items that repeat an id are
    listed once.  Ids may have any type.  Either table may be empty.  Words are compared by
    64-bit hashes.  A benchmark larger than block_bytes is searched a block at a time.
    Columns of docs that have the name of a new one are replaced.
    """
    item_type = benchmark.schema[item_col].dataType
    arrow = to_arrow_type(item_type)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    blocks = Blocks(benchmark, item_col, item_text_col, window, block_bytes)
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", span), T.StructField("item_ids", T.ArrayType(item_type)),
        T.StructField("longest_words", T.LongType()), T.StructField("longest_at", T.LongType()), T.StructField("longest_item", item_type),
    ]

    def measure():
        def measured(texts: pa.Array) -> list[pa.Array]:
            text = Text.of(texts)
            hit = np.zeros(len(text.hashes), bool)
            items: dict[int, list] = {}
            longest: dict[int, tuple] = {}
            occurrences = []
            for tests in blocks:
                found = search(text, tests)
                hit |= found.hit
                occurrences.append((found.at, found.size))
                for doc, ids in found.items.items():
                    have = items.setdefault(doc, [])
                    have += [i for i in dict.fromkeys(ids) if i not in have]
            at, size = (np.concatenate(x) for x in zip(*occurrences, strict=True))
            for tests in blocks if len(at) else ():  # an item of one block may hold the windows of another
                for doc, best in longest_by_document(tests, text, at, size).items():
                    longest[doc] = min((longest.get(doc, best), best), key=lambda b: (-b[0], b[1], b[2] is not None, b[2] if b[2] is not None else 0))
            covered = np.concatenate([[0], np.cumsum(hit)])
            n = range(len(texts))
            spans = [hit_spans(hit[text.first[i] : text.first[i + 1]]) if i in items else [] for i in n]
            none = (0, None, None)
            return [
                pa.array(np.diff(text.first), pa.int64()), pa.array(covered[text.first[1:]] - covered[text.first[:-1]], pa.int64()), pa.array(spans, arrow_span),
                pa.array([items.get(i, []) for i in n], pa.list_(arrow)), *[pa.array([longest.get(i, none)[k] for i in n], t) for k, t in enumerate((pa.int64(), pa.int64(), arrow))],
            ]

        return measured

    out = attach(docs.drop("contaminated"), text_col, fields, measure, blocks.shard_bytes, keep)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each item its longest verbatim match in any document, of `window` words or more:
    item_id, words, item_word, id and doc_word where both begin.

    Ties go to the earliest word of the item, then to the smallest id (null first), then to the
    earliest word of the document.  Items without any match, without words or with a null text have no row, as have
    all of them if either table is empty; items that repeat an id have one row."""
    small_arrow_batches(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    item_type = benchmark.schema[item_col].dataType
    arrow = to_arrow_type(item_type)
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("words", T.LongType()), T.StructField("item_word", T.LongType()), rows.schema[ID], T.StructField("doc_word", T.LongType())])
    blocks = Blocks(benchmark, item_col, item_text_col, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SHARD_BYTES):
            text = Text.of(batch.column(1))
            rank = pc.rank(batch.column(0), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
            for tests in blocks:
                shard = Shard(tests.numbers(text.hashes), text.owner, window, int(tests.length.max(initial=1)))
                found = [f for f in longest_by_item(shard, tests, text, rank) if f[1] >= window] if len(shard.suffixes) else []
                if found:
                    item, size, item_word, row, word = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tests.items[i] for i in item], arrow), pa.array(size, pa.int64()), pa.array(item_word, pa.int64()), batch.column(0).take(pa.array(row)), pa.array(word, pa.int64())],
                        ["item_id", "words", "item_word", ID, "doc_word"],
                    )

    best = F.min(F.struct(-F.col("words"), F.col("item_word"), F.col(ID), F.col("doc_word"), F.col("words"))).alias("b")
    return rows.mapInArrow(run, schema).groupBy("item_id").agg(best).select("item_id", "b.words", "b.item_word", F.col(f"b.{ID}").alias(id_col), "b.doc_word")
