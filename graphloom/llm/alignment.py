"""Tokens of two tokenizers aligned over the same bytes, by a dangling-suffix transducer.

The transducer reads the tokens of both sides.  Its state is the side that leads and the
bytes by which it leads (the dangling suffix); the next token comes from the side behind, or
from A where nothing dangles.  A transition depends on state and token alone and is
remembered.  Where nothing dangles any more, both sides end at the same byte and a group of
tokens closes.

1. A slice of documents at a time is encoded and aligned where it is read.  Text is cut at
   single spaces between words if no token of either side crosses those (probed when the files
   are loaded), so each distinct word is encoded and aligned once for a slice, or once for a
   worker while its memory lasts.  A slice's distinct linked pairs become its dictionary; a
   document is stored as places in it.
2. Dictionaries alone are shuffled: by pair, to count the documents that hold it, and back by
   slice.  Each key is met once a slice, so common pairs are as rare as others.
3. Documents meet the counted dictionary of their slice: bounded groups, made of one slice.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters
from .shared import ID, TEXT, id_text, slices, small_arrow_batches, stored

#: Text of a slice, which shares one dictionary.
SLICE_BYTES = 4 << 20
#: Words that a worker remembers, and the longest of them.
CACHED_WORDS, CACHED_LENGTH = 200_000, 48
#: Words that are encoded at once.
LEARNED = 32_768
#: Links of a group above which equal tokens are taken together first.
WIDE = 256
#: States and transitions that a transducer remembers.
REMEMBERED = 500_000
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
WHITE = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class DanglingSuffix:
    """Groups of tokens between the bytes at which the tokens of both sides end."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.width = max(len(a_bytes), len(b_bytes))
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[tuple[bool, bytes], int] = {(False, b""): 0}
        #: Whether A leads, and by which bytes, by number of state; in state 0 nothing dangles.
        self.states: list[tuple[bool, bytes]] = [(False, b"")]
        self.a_leads = np.zeros(1, bool)
        #: Known transitions: state * width + token, ascending, and the state that follows.
        self.keys, self.after = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def move(self, state: int, token: int) -> int:
        """The state after the next token of the side behind; -1 where bytes differ."""
        a_leads, dangling = self.states[state]
        read = self.bytes[a_leads][token]  # the side behind: B if A leads
        if dangling.startswith(read):
            after = (a_leads, dangling[len(read) :])
        elif read.startswith(dangling):
            after = (not a_leads, read[len(dangling) :])
        else:
            return -1
        if not after[1]:
            return 0
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
        return self.numbers[after]

    def moves(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """move() of many, remembered."""
        wanted = state * self.width + token
        at = np.searchsorted(self.keys, wanted)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == wanted[known]
        if not known.all():
            new = np.unique(wanted[~known])
            made = np.array([self.move(*divmod(k, self.width)) for k in new.tolist()], np.int64)
            where = np.searchsorted(self.keys, new)
            self.keys, self.after = np.insert(self.keys, where, new), np.insert(self.after, where, made)
            self.a_leads = np.fromiter((a for a, _ in self.states), bool, len(self.states)) if len(self.states) > len(self.a_leads) else self.a_leads
            at = np.searchsorted(self.keys, wanted)
        return self.after[at]

    def groups(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of many words on both sides, read in step: the group of each token of A and of B
        inside its word, and the number of groups of each word, 0 if its sides differ."""
        if len(self.keys) > REMEMBERED:
            self.forget()
        n = len(a_ends)
        i, j = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
        state, closed = np.zeros(n, np.int64), np.zeros(n, np.int64)
        of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        live = np.arange(n)
        while len(live):
            from_b = self.a_leads[state[live]]
            lacking = np.where(from_b, j[live] == b_ends[live], i[live] == a_ends[live])
            if lacking.any():  # a word ends here, well if nothing dangles and nothing is left
                ended = live[lacking]
                closed[ended[(state[ended] != 0) | (j[ended] < b_ends[ended]) | (i[ended] < a_ends[ended])]] = 0
                live, from_b = live[~lacking], from_b[~lacking]
            token = np.empty(len(live), np.int64)
            side_b, side_a = live[from_b], live[~from_b]
            token[from_b], token[~from_b] = b[j[side_b]], a[i[side_a]]
            of_b[j[side_b]], of_a[i[side_a]] = closed[side_b], closed[side_a]
            j[side_b] += 1
            i[side_a] += 1
            after = self.moves(state[live], token)
            closed[live[after < 0]] = 0
            live, after = live[after >= 0], after[after >= 0]
            state[live] = after
            closed[live] += after == 0
        return of_a, of_b, closed


class Pair:
    """Two tokenizers: a byte-level file of the tokenizers library (A), a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letter = {c: b for b, c in enumerate(byte_letters())}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        a_bytes = [bytes(letter[c] for c in name) if all(c in letter for c in name) else name.encode() for name in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(WHITE, " ").encode() for p in pieces]
        self.transducer = DanglingSuffix(a_bytes, b_bytes)
        self.a_bytes, self.width = a_bytes, len(pieces)
        self.shown = [str(i) for i in range(self.transducer.width)]
        #: Without a normalizer, byte-level tokens spell the text as it is.
        self.faithful = self.a.normalizer is None and letter.keys() <= set(names)
        self.cuts = not any(WHITE in p.lstrip(WHITE) for p in pieces) and self.probed()
        self.forget()

    def probed(self) -> bool:
        """Whether both sides encode a text as its words, each with the space before it."""
        words = ["the", "Don't", "x1y2,", "#-#.", "a", "'s", "ÀÉ", "ß", "日本\n語", "😀 é", "(1)", "2024", "\tc", "..?!"]
        words = BETWEEN_WORDS.split(" ".join(words))
        whole, single = self.ids([" ".join(words)])[0], self.ids(words)
        return all(whole[side] == sum((w[side] for w in single), []) for side in (0, 1))

    def ids(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and of B, of each text with a space before it."""
        a = self.a.encode_batch([f" {t}" for t in texts], add_special_tokens=False)
        return list(zip((x.ids for x in a), self.b.encode(texts, num_threads=1), strict=True))

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.spelled: list[str] = []  # groups as text, empty for words whose bytes differ
        #: tokens of A, of B, groups, links, entries in pairs of each word
        self.sizes = np.zeros((0, 5), np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode and align words that are not known yet."""
        ids = self.ids(words)
        sides = []
        for k in (0, 1):
            ends = np.cumsum(np.fromiter((len(x[k]) for x in ids), np.int64, len(ids)))
            sides.append((np.fromiter(chain.from_iterable(x[k] for x in ids), np.int64, int(ends[-1])), ends))
        (a, a_ends), (b, b_ends) = sides
        of_a, of_b, closed = self.transducer.groups(a, a_ends, b, b_ends)
        if not self.faithful:
            closed[[b"".join(map(self.a_bytes.__getitem__, x)) != f" {word}".encode() for word, (x, _) in zip(words, ids, strict=True)]] = 0
        # tokens of words that are spelled alike, numbered by group through all words
        base = np.cumsum(closed) - closed
        long_a, long_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        good = closed > 0
        in_a, in_b = np.repeat(good, long_a), np.repeat(good, long_b)
        group_a, group_b = (of_a + np.repeat(base, long_a))[in_a], (of_b + np.repeat(base, long_b))[in_b]
        a, b = a[in_a], b[in_b]
        total = int(closed.sum())
        size_a, size_b = np.bincount(group_a, minlength=total), np.bincount(group_b, minlength=total)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        word = np.repeat(np.arange(len(words)), closed)
        single = (size_a == 1) & (size_b == 1)
        pair = a[first_a[single]] * self.width + b[first_b[single]]
        texts = np.empty(total, object)
        distinct, place = np.unique(pair, return_inverse=True)
        texts[single] = np.array([f"{x}|{y}" for x, y in zip(*(v.tolist() for v in np.divmod(distinct, self.width)), strict=True)] or [""], object)[place]
        owners, pairs, times = [word[single]], [pair], [np.ones(len(pair), np.int64)]
        several = np.flatnonzero(~single)
        a_shown, b_shown = (list(map(self.shown.__getitem__, v.tolist())) for v in (a, b))
        for g, i, n, j, m in zip(*(v.tolist() for v in (several, first_a[several], size_a[several], first_b[several], size_b[several])), strict=True):
            texts[g] = f"{','.join(a_shown[i : i + n])}|{','.join(b_shown[j : j + m])}"
        wide_ones = size_a[several] * size_b[several] > WIDE
        for g in several[wide_ones].tolist():
            (left, n), (right, m) = (np.unique(v[f[g] : f[g] + k[g]], return_counts=True) for v, f, k in ((a, first_a, size_a), (b, first_b, size_b)))
            pairs.append((left[:, None] * self.width + right).reshape(-1))
            times.append(np.outer(n, m).reshape(-1))
            owners.append(np.full(len(pairs[-1]), word[g]))
        several = several[~wide_ones]
        links = size_a[several] * size_b[several]
        g = np.repeat(several, links)
        row, column = np.divmod(np.arange(len(g)) - np.repeat(np.cumsum(links) - links, links), size_b[g])
        pairs.append(a[first_a[g] + row] * self.width + b[first_b[g] + column])
        times.append(np.ones(len(g), np.int64))
        owners.append(word[g])
        owner, pair, often = (np.concatenate(x) for x in (owners, pairs, times))
        order = np.argsort(owner, kind="stable")
        known, at = len(self.spelled), 0
        texts = texts.tolist()
        for number, (w, n) in enumerate(zip(words, closed.tolist(), strict=True), known):
            self.places[w] = number
            self.spelled.append(";".join(texts[at : at + n]))
            at += n
        links = np.bincount(owner, often, len(words)).astype(np.int64)
        self.sizes = np.concatenate([self.sizes, np.stack([long_a * good, long_b * good, closed, links, np.bincount(owner, minlength=len(words))], 1)])
        self.pairs, self.times = np.concatenate([self.pairs, pair[order]]), np.concatenate([self.times, often[order]])

    def words(self, text: str) -> list[str]:
        return [] if not text else BETWEEN_WORDS.split(text) if self.cuts else [text]

    def measure(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Sizes (A, B, groups, links) and groups of each text; then all linked (text, pair, times), ordered."""
        split = [self.words(t) for t in texts]
        new = set().union(*split).difference(self.places) if split else set()
        kept = len(self.spelled)
        again = [w for w, n in Counter(chain.from_iterable(split)).items() if n > 1 and w in new and len(w) <= CACHED_LENGTH] if kept < CACHED_WORDS else []
        again = again[: CACHED_WORDS - kept]  # words met once may never come again
        known, keep = again + list(new.difference(again)), len(again)
        for at in range(0, len(known), LEARNED):
            self.learn(known[at : at + LEARNED])
        place, spelled = self.places.__getitem__, self.spelled.__getitem__
        at = [np.fromiter(map(place, words), np.int64, len(words)) for words in split]
        bad = self.sizes[:, 2] == 0
        at = [np.zeros(0, np.int64) if bad[x].any() else x for x in at]
        sizes = np.array([self.sizes[x, :4].sum(0) for x in at], np.int64).reshape(-1, 4)
        groups = [";".join(map(spelled, x.tolist())) for x in at]
        starts = np.cumsum(self.sizes[:, 4]) - self.sizes[:, 4]
        n = max(1, len(self.spelled))
        met, often = np.unique(np.concatenate([np.zeros(0, np.int64), *(x + i * n for i, x in enumerate(at))]), return_counts=True)
        text, word = np.divmod(met, n)
        long = self.sizes[word, 4]
        flat = np.repeat(starts[word] - np.cumsum(long) + long, long) + np.arange(long.sum())
        text, pair, times = np.repeat(text, long), self.pairs[flat], self.times[flat] * np.repeat(often, long)
        for word_ in known[keep:]:
            del self.places[word_]
        ends = kept + keep
        del self.spelled[ends:]
        self.sizes = self.sizes[:ends]
        last = int(self.sizes[:, 4].sum())
        self.pairs, self.times = self.pairs[:last], self.times[:last]
        return sizes, groups, text, pair, times


@cache
def tokenizers_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def narrow(values: np.ndarray) -> bytes:
    """Numbers in the fewest of 1, 2, 4 or 8 bytes each; how many there are is kept elsewhere."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if most < 1 << 8 * w)).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def sliced(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, slice_bytes: int) -> DataFrame:
    """One row per document: its sizes, the hash of its groups, and its pairs as places in the
    dictionary of its slice, which stands in the slice's first row as pairs (a * pieces of B + b)
    and the numbers of documents that hold them."""
    small_arrow_batches(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    names = ["slice", ID, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "places", "times", "pairs", "holders"]
    kinds = [T.LongType(), rows.schema[ID].dataType, *[T.LongType()] * 4, T.StringType(), T.LongType(), T.BinaryType(), T.BinaryType(), T.ArrayType(T.LongType()), T.ArrayType(T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part = tokenizers_of(a_path, b_path), TaskContext.get().partitionId() << 32
        for number, batch in enumerate(slices(batches, slice_bytes)):
            sizes, groups, text, pair, times = both.measure(batch.column(1).to_pylist())
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            distinct, place = np.unique(pair, return_inverse=True)
            key, where = np.unique(text * max(1, len(distinct)) + place, return_inverse=True)
            times = np.bincount(where, times, len(key)).astype(np.int64)
            text, place = np.divmod(key, max(1, len(distinct)))
            n, none = batch.num_rows, [None] * (batch.num_rows - 1)
            cuts = np.searchsorted(text, np.arange(n + 1))
            own = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [
                pa.array(np.full(n, part + number)), batch.column(0), *(pa.array(sizes[:, k]) for k in range(4)), pa.array(digests, pa.string()),
                pa.array(np.diff(cuts)), pa.array([narrow(np.diff(place[s], prepend=0)) for s in own], pa.binary()), pa.array([narrow(times[s]) for s in own], pa.binary()),
                pa.array([distinct, *none], pa.list_(pa.int64())), pa.array([np.bincount(place, minlength=len(distinct)), *none], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def dictionaries(table: DataFrame) -> DataFrame:
    """(slice, pair, holders) of all slices."""
    whole = table.where("pairs is not null").select("slice", F.explode(F.arrays_zip("pairs", "holders")).alias("of"))
    return whole.select("slice", "of.pairs", "of.holders").withColumnRenamed("pairs", "pair")


def counted(table: DataFrame, pieces: int) -> DataFrame:
    """(pair, n_docs, best): documents that hold a linked pair, and whether no pair of its A id has more.

    The pairs of one A id are at most as many as B has pieces."""
    from pyspark.sql import Window

    counts = dictionaries(table).groupBy("pair").agg(F.sum("holders").alias("n_docs"))
    of_a = Window.partitionBy(F.expr(f"pair div {pieces}"))
    return counts.select("pair", "n_docs", (F.col("n_docs") == F.max("n_docs").over(of_a)).alias("best"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The corpus's alignment: a_id, b_id, n_docs (documents that hold them linked), best (ties included)."""
    pieces = tokenizers_of(a_path, b_path).width
    found = counted(stored(sliced(docs, a_path, b_path, id_col, text_col, slice_bytes), "aligned"), pieces)
    return found.select(F.expr(f"cast(pair div {pieces} as int)").alias("a_id"), (F.col("pair") % pieces).cast("int").alias("b_id"), "n_docs", "best")


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per input row: id, groups, as text `a1,a2|b1;a3|b2,b3`; empty for texts without tokens."""
    small_arrow_batches(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers_of(a_path, b_path)
        for batch in slices(batches, slice_bytes):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both.measure(batch.column(1).to_pylist())[1], pa.string())], [ID, "groups"])

    return rows.mapInArrow(run, T.StructType([rows.schema[ID], T.StructField("groups", T.StringType())])).withColumnRenamed(ID, id_col)


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are encoded whole, with a space before them (B adds it), special tokens as plain
    text.  A link is a token of A and one of B whose bytes share a group.  n_best counts the
    links whose pair of ids is held by as many documents as any of that A id; count_sum adds up
    the documents that hold the pair of each link.  Null and empty texts, and texts that A or B
    does not spell byte for byte (U+2581 for one), have zeros and an empty groups_sha256; they
    hold no pairs.  Repeated and null ids are rows of their own; an empty table gives an empty
    result.  Both files must be at the same path on every machine.
    """
    pieces = tokenizers_of(a_path, b_path).width
    table = stored(sliced(docs, a_path, b_path, id_col, text_col, slice_bytes), "aligned")
    looked_up = dictionaries(table).select(F.col("slice").alias("of_slice"), "pair").join(counted(table, pieces), "pair")
    own = table.select("slice", ID, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "places", "times")
    kinds = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    schema = T.StructType([table.schema[ID], *kinds, T.StructField("groups_sha256", T.StringType())])
    names = schema.names

    def weigh(mine: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts.column("pair").to_numpy())
        n_docs = counts.column("n_docs").to_numpy()[order]
        best = np.asarray(counts.column("best"))[order]
        n_best, count_sum = [], []
        for n, places, times in zip(*(mine.column(c).to_pylist() for c in ("n_pairs", "places", "times")), strict=True):
            at, often = np.cumsum(wide(places, n)), wide(times, n)
            n_best.append(int(often[best[at]].sum()) if n else 0)
            count_sum.append(int((often * n_docs[at]).sum()) if n else 0)
        columns = [mine.column(c) for c in names[:5]] + [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), mine.column("groups_sha256")]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

    return own.groupBy("slice").cogroup(looked_up.groupBy("of_slice")).applyInArrow(weigh, schema).withColumnRenamed(ID, id_col)
