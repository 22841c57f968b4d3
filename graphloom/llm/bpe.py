"""BPE encoding and decoding with a pair occurrence index.

All distinct unseen words of a partition slice are laid out as one linked symbol
sequence.  An index maps each mergeable pair to all its positions.  Active ranks
are taken in ascending order; one step merges every occurrence of a pair at once
and updates the lists of the neighbouring pairs.  This gives the greedy result of
each word by itself because a merge only creates pairs of higher rank, which is
checked when the vocabulary is loaded.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import ID, TEXT, id_text, slices, small_arrow_batches

#: Words that a worker remembers.
CACHED_WORDS = 200_000
FINAL_STOP = re.compile(r"(?<=[a-zß-öø-ÿ])([.,])(?= |$)")
#: Text that shares one pair index; what a worker holds beside its words is many times that.
SLICE_BYTES = 2 << 20


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class PairIndexBpe:
    """A byte-level BPE vocabulary file of the tokenizers library, applied by pair index."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if not splits_at_spaces(self.library):
            raise ValueError("a vocabulary whose tokens never cross white space is needed")
        self.lowers = drops_case(self.library)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        letters = byte_letters()
        self.letter_bytes = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        made = np.full(self.size, -1, np.int64)
        pairs = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if max(made[a], made[b]) >= rank:
                raise ValueError("merges are not in the order in which they were learned")
            made[c] = max(made[c], rank)
            pairs.append((a * self.size + b, rank, c))
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.keys, self.ranks = table[:, 0], table[:, 1]
        self.merged = np.zeros(len(pairs), np.int64)
        self.merged[self.ranks] = table[:, 2]
        self.left, self.right = np.zeros((2, len(pairs)), np.int64)
        self.left[self.ranks], self.right[self.ranks] = np.divmod(self.keys, self.size)
        self.by_key = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        self.tokens = [(self.library.id_to_token(i) or "").encode() for i in range(self.size)]
        self.words: dict[str, bytes] = {}

    # ---- encoding -------------------------------------------------------------

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it cannot be merged."""
        keys = a * self.size + b
        if len(keys) < 24:
            return np.fromiter((self.by_key.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces after all merges, and how many each piece has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        last = np.cumsum(lengths) - 1
        symbol = np.append(self.inner[raw], -1)
        symbol[last] = self.final[raw[last]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[last], before[last - lengths + 1] = n, n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions into the index."""
            rank = self.rank_of(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, positions in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(positions)
                else:
                    index[r] = [positions]
                    heapq.heappush(active, r)

        whole = np.arange(n)
        note(whole[after[whole] < n])
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[rank], self.right[rank]
            at = np.unique(at[(symbol[at] == a) & (symbol[after[at]] == b)])
            if a == b and len(at) > 1:
                at = apart(at, after)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at], symbol[gone] = self.merged[rank], -1
            after[at] = beyond
            before[beyond] = at
            left = before[at]
            note(np.concatenate([left[left < n], at[beyond < n]]))
        alive = symbol[:n] >= 0
        return symbol[:n][alive], np.add.reduceat(alive, last - lengths + 1, dtype=np.int64) if n else lengths

    def pieces(self, word: str) -> list[bytes]:
        """The byte strings to be merged for a word without ASCII white space, by the file's own rules."""
        text = self.library.normalizer.normalize_str(word) if self.library.normalizer else word
        found = self.library.pre_tokenizer.pre_tokenize_str(text) if self.library.pre_tokenizer else [(text, None)]
        letter = self.letter_bytes
        return [bytes([letter[c] for c in piece]) for piece, _ in found]

    def learn(self, words: Iterable[str]) -> None:
        """Encode words into the cache."""
        distinct: dict[bytes, int] = {}
        plans: list[tuple[str, list[int]]] = []
        for word in words:
            if self.lowers and word.isascii() and word.isalpha():
                pieces = [word.lower().encode()]
            else:
                pieces = []
                for part, special in self.special_parts(word):
                    if special is not None:
                        pieces.append(special)
                    elif part:
                        pieces += self.pieces(part)
            plans.append((word, [p if isinstance(p, int) else distinct.setdefault(p, len(distinct)) for p in (-1 - x if isinstance(x, int) else x for x in pieces)]))
        if distinct:
            ids, counts = self.merge_all(list(distinct))
            packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        starts = [0, *ends[:-1]] if distinct else []
        for word, plan in plans:
            self.words[word] = b"".join((-1 - k).to_bytes(4, "little") if k < 0 else packed[starts[k] : ends[k]] for k in plan)

    def special_parts(self, word: str) -> list[tuple[str, int | None]]:
        """A word cut at the added tokens that it contains."""
        parts: list[tuple[str, int | None]] = [(word, None)]
        for content, number in self.specials.items():
            if content in word:
                cut: list[tuple[str, int | None]] = []
                for part, special in parts:
                    if special is not None or content not in part:
                        cut.append((part, special))
                        continue
                    for i, piece in enumerate(part.split(content)):
                        cut += [(content, number)] * (i > 0) + [(piece, None)]
                parts = cut
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [word_parts(text, self.lowers) for text in texts]
        new = set().union(*split).difference(self.words)
        full = len(self.words) + len(new) > CACHED_WORDS
        self.learn(sorted(new))
        known = self.words.__getitem__
        out = [b"".join(map(known, words)) for words in split]
        if full:  # what was met first stays; the rest is forgotten at once
            for word in new:
                del self.words[word]
        return out

    # ---- decoding -------------------------------------------------------------

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 text of packed ids, special tokens included.

        Without a decoder in its file the library joins token strings by a space."""
        if self.library.decoder is not None:
            return self.library.decode(np.frombuffer(packed, "<u4").tolist(), skip_special_tokens=False).encode()
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def splits_at_spaces(library) -> bool:
    """Whether a file's ids of a text are those of its words, and of a full stop or comma by itself."""

    def ids(text: str) -> list[int]:
        return list(library.encode(text, add_special_tokens=False).ids)

    probes = [["ab", ",", "Cd", "e", "."], ["the", "Don't", "x1y2", "#-#", "ÀÉ", "ß", ","], ["a", "a", "1", "1", "2024", "."], ["日本", "語", "😀", "e\u0301", "..", "?!"]]
    joined = (" ", "\n", "\t", "  ", " \n ")
    return all(ids(space.join(parts)) == sum(map(ids, parts), []) for parts in probes for space in joined) and ids("ab, Cd e.") == sum(map(ids, probes[0]), [])


def drops_case(library) -> bool:
    return library.encode("ÀB cd", add_special_tokens=False).ids == library.encode("àb cd", add_special_tokens=False).ids


def word_parts(text: str, lowers: bool) -> list[str]:
    """A text cut where no token can cross: at ASCII white space and, in Latin-1 text, before a
    single full stop or comma that follows a letter.  Case is dropped early if the file drops it."""
    text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    if lowers and "<" not in text:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split(" ")
        text = FINAL_STOP.sub(r" \1", text.lower())
    return text.split(" ")


def apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences of a pair of equal symbols, every second one from the left."""
    chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
    place = np.arange(len(at))
    head = np.maximum.accumulate(np.where(chained, 0, place))
    return at[(place - head) % 2 == 0]


@cache
def vocabulary(name: str) -> PairIndexBpe:
    return PairIndexBpe(name)


def local_path(path: str, shipped: bool) -> str:
    """A worker's place of the vocabulary: the path itself, or the copy that Spark shipped."""
    return SparkFiles.get(path.rsplit("/", 1)[-1]) if shipped else path


def round_trip_batches(path: str, shipped: bool, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(local_path(path, shipped))
        for batch in slices(batches, SLICE_BYTES):
            packed = bpe.encode(batch.column(1).to_pylist())
            for at in range(0, len(packed), 256):
                part = packed[at : at + 256]
                columns = [batch.column(0).slice(at, len(part)), pa.array([len(p) // 4 for p in part], pa.int64()), pa.array(part, pa.binary())]
                if decode:
                    columns.append(pa.array([bpe.decode(p) for p in part], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [ID, "n_tokens", "ids", "decoded"][: len(columns)])

    return run


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ship: bool = False, decode: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids (packed little-endian uint32), decoded text.

    Equals the tokenizers library's encode without added specials, truncation or
    padding, and its decode with specials kept.  A null text counts as empty: no ids,
    empty decoded text.  Text of any length is encoded whole.  `path` must exist on
    every machine, or ship=True sends the file to the executors.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    if ship:
        spark.sparkContext.addFile(path)
    rows = id_text(docs, id_col, text_col)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    schema = T.StructType([rows.schema[ID], *fields[: 2 + decode]])
    return rows.mapInArrow(round_trip_batches(path, ship, decode), schema).withColumnRenamed(ID, id_col)
