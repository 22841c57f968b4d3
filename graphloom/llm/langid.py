"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language.  An unseen word is
scored by its character n-grams, longest first: the first length of which any n-gram
is known decides, and its evidence weighs less for each length given up.

Words and n-grams are 64-bit hashes of code points, so a whole slice of texts is scored
with array operations, and the model is a few sorted arrays: its size follows the words
of the training sample, whatever the number of languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ID, TEXT, attach, slices, small_arrow_batches, stored, text_buffers
from .wordhash import BASE, MIX1, mix, run_hashes

#: Training rows (a bounded hash sample of the labelled rows) and the longest n-gram.
MAX_ROWS, LONGEST = 8_000, 4
#: Files of the sample's word counts, at most.
MODEL_FILES = 16
#: Weight of an unseen word's evidence for each n-gram length given up, the word itself being the first.
BACKOFF = 0.4
#: Added to every count, so that what a language lacks is unlikely and not impossible.
SMOOTHING = 0.5
#: Code points that stand for the beginning and the end of a word in n-grams of two or more.
BEGIN, END = 0x110000, 0x110001
#: Text whose words are taken together, and words of the model whose n-grams are.
SLICE_BYTES, PIECE_WORDS = 1 << 20, 1 << 15
UNDETERMINED = "und"


def hash_fraction(column: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.shiftrightunsigned(F.xxhash64(column.cast("string"), F.lit(seed)), 11) * F.lit(2.0**-53)


def bounded_sample(rows: DataFrame, key: str | Column, limit: int, seed: int) -> DataFrame:
    """All rows if there are at most `limit`, else about `limit` of them, chosen by a hash of the key."""
    total = rows.count()
    return rows if total <= limit else rows.where(hash_fraction(F.col(key) if isinstance(key, str) else key, seed) < limit / total)


# ---- words as numbers ------------------------------------------------------------


@cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower case where that is one code point."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4:  # ideographs and syllables, without case
            letter[c] = unicodedata.category(chr(c))[0] == "L"
        elif not 0xD800 <= c < 0xF900 and c < 0x32000:
            name = chr(c)
            letter[c] = unicodedata.category(name)[0] == "L"
            if letter[c] and len(name.lower()) == 1:
                lower[c] = ord(name.lower())
    return letter, lower


@dataclass
class Words:
    """The words (runs of letters, lower-cased) of some texts."""

    points: np.ndarray  # code points of all texts
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray  # text of each word
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        letter, lower = characters()
        # a line feed after each text keeps words apart
        points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.concatenate([[False], letter[points]])
        start = np.flatnonzero(inside[1:] & ~inside[:-1])
        end = np.flatnonzero(inside[:-1] & ~inside[1:])
        points = lower[points]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        return cls(points, start, end, np.searchsorted(ends, start, side="right"), run_hashes(points, start, end))

    def text(self, k: int) -> str:
        return self.points[self.start[k] : self.end[k]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def grams(points: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of some words, and the word of each.

    Words have a mark at either end in n-grams of two or more; single characters are letters alone."""
    edge = int(size > 1)
    lengths = end - start + 2 * edge
    heads = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(heads, lengths)
    owner = np.repeat(np.arange(len(start)), lengths)
    at = np.clip(np.repeat(start - edge, lengths) + place, 0, max(len(points) - 1, 0))
    symbols = points[at].astype(np.uint64) if len(points) else np.zeros(0, np.uint64)
    if edge:
        symbols[place == 0] = BEGIN
        symbols[place == np.repeat(lengths, lengths) - 1] = END
    keep = place <= np.repeat(lengths, lengths) - size
    first = np.flatnonzero(keep)
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        out = out * BASE + symbols[first + k] + np.uint64(1)
    return mix(out + np.uint64(size * int(MIX1) % (1 << 64))), owner[first]


# ---- the model ---------------------------------------------------------------------


def summed(hashes: np.ndarray, language: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, language, count) rows in order, repeated ones added up."""
    order = np.lexsort((language, hashes))
    hashes, language, counts = hashes[order], language[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (language[1:] != language[:-1])])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[at], language[at], np.add.reduceat(counts, at) if len(at) else counts


@dataclass
class Level:
    """Counts of words, or of n-grams of one length, as log frequencies.

    A language's value for an entry is its `base` plus, if it has the entry, a gain."""

    hashes: np.ndarray  # sorted
    first: np.ndarray  # where each entry's gains begin; one more at the end
    language: np.ndarray
    gain: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, language: np.ndarray, counts: np.ndarray, languages: int) -> Level:
        """From (hash, language, count) rows; repeated ones are added up."""
        hashes, language, counts = summed(hashes, language, counts)
        entries, first = np.unique(hashes, return_index=True)
        total = np.bincount(language, counts, languages) + SMOOTHING * (len(entries) + 1)
        gain = np.log(counts + SMOOTHING) - np.log(SMOOTHING)
        return cls(entries, np.append(first, len(hashes)).astype(np.int64), language.astype(np.int32), gain.astype(np.float32), np.log(SMOOTHING) - np.log(total))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add(self, logs: np.ndarray, rows: np.ndarray, entry: np.ndarray, weight: np.ndarray) -> None:
        """Add weight times the values of the entries to the given rows of logs."""
        n, width = logs.shape
        logs += np.bincount(rows, weight, n)[:, None] * self.base
        counts = self.first[entry + 1] - self.first[entry]
        at = np.repeat(self.first[entry] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        cells = np.repeat(rows, counts) * width + self.language[at]
        logs += np.bincount(cells, np.repeat(weight, counts) * self.gain[at], n * width).reshape(n, width)


class BackoffModel:
    """Levels of words and of n-grams of falling length."""

    def __init__(self, counts: pa.Table, longest: int = LONGEST, backoff: float = BACKOFF):
        """counts: columns word, label and n; a word once for each label."""
        labels = counts.column("label").combine_chunks().dictionary_encode()
        names = labels.dictionary.to_pylist()
        self.languages, self.longest, self.backoff = sorted(names), longest, backoff
        language = np.searchsorted(np.array(self.languages, object), np.array(names, object)).astype(np.int64)[labels.indices.to_numpy()] if names else np.zeros(0, np.int64)
        n = counts.column("n").to_numpy().astype(np.float64)
        words = counts.column("word").combine_chunks()
        data, ends = text_buffers(words)
        points = np.frombuffer(data[ends[0] : ends[-1]].tobytes().decode().encode("utf-32-le"), np.uint32)
        end = np.cumsum(pc.utf8_length(words).to_numpy()).astype(np.int64)
        start = np.concatenate([[0], end[:-1]]) if len(end) else end
        self.words = Level.of(run_hashes(points, start, end), language, n, len(names))
        #: by length
        self.grams: dict[int, Level] = {}
        for size in range(1, longest + 1):
            parts = []
            for at in range(0, len(start), PIECE_WORDS):  # most n-grams repeat: little is left of a piece
                hashes, owner = grams(points, start[at : at + PIECE_WORDS], end[at : at + PIECE_WORDS], size)
                parts.append(summed(hashes, language[at + owner], n[at + owner]))
            empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
            self.grams[size] = Level.of(*(np.concatenate(x) for x in zip(*(parts or [empty]), strict=True)), len(names))

    def logs(self, words: Words, texts: int) -> np.ndarray:
        """Log evidence of each text for each language."""
        out = np.zeros((texts, len(self.languages)))
        entry = self.words.find(words.hashes)
        known = np.flatnonzero(entry >= 0)
        self.words.add(out, words.owner[known], entry[known], np.ones(len(known)))
        left = np.flatnonzero(entry < 0)
        for size in range(self.longest, 0, -1):
            if not len(left):
                break
            hashes, owner = grams(words.points, words.start[left], words.end[left], size)
            entry = self.grams[size].find(hashes)
            hit = np.flatnonzero(entry >= 0)
            # the mean over the known n-grams of the word, at the weight of this length
            found = np.bincount(owner[hit], minlength=len(left))
            weight = self.backoff ** (self.longest + 1 - size) / found[owner[hit]]
            self.grams[size].add(out, words.owner[left[owner[hit]]], entry[hit], weight)
            left = left[found == 0]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Best language and its posterior under equal priors; `und`, 0 without letters."""
        words = Words.of(texts)
        lettered = np.bincount(words.owner, minlength=len(texts)) > 0
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        logs = self.logs(words, len(texts))
        best = logs.argmax(1)
        score = np.where(lettered, 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1), 0.0)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (label, text): the words of each slice with their counts, (label, word, n)."""
    for batch in slices(batches, SLICE_BYTES):
        labels = batch.column(0).to_pylist()
        words = Words.of([t or "" for t in batch.column(1).to_pylist()])
        names, number = np.unique(np.array(labels, object), return_inverse=True)
        order = np.lexsort((words.hashes, number[words.owner]))
        label, hashes = number[words.owner][order], words.hashes[order]
        heads = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (hashes[1:] != hashes[:-1])])) if len(order) else order
        n = np.diff(np.append(heads, len(order)))
        rows = [pa.array([names[k] for k in label[heads]], pa.string()), pa.array([words.text(k) for k in order[heads]], pa.string()), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(rows, ["label", "word", "n"])


def train(docs: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, longest: int = LONGEST) -> BackoffModel:
    """Fit on a bounded hash sample (max_rows) of the rows that have both label and text.

    All words of the sample and all labels enter the model.  The sample is chosen by id and
    text, so rows that repeat both are in or out together; null ids count as a value."""
    labelled = docs.select(F.col(id_col).alias(ID), F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias(TEXT)).where(F.col("label").isNotNull() & F.col(TEXT).isNotNull())
    small_arrow_batches(docs.sparkSession)
    sample = bounded_sample(labelled, F.concat_ws(":", F.col(ID).cast("string"), F.xxhash64(TEXT).cast("string")), max_rows, 7)
    words = sample.select("label", TEXT).mapInArrow(count_batches, "label string, word string, n long")
    counts = stored(words.groupBy("label", "word").agg(F.sum("n").alias("n")), "word-counts", MODEL_FILES).toArrow()
    return BackoffModel(counts, longest)


def identify_language(docs: DataFrame, model: BackoffModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred and score, row by row.

    A text that is null, empty or without letters gets `und` and score 0; so does any
    text under a model without languages.  Ties go to the alphabetically first language: a
    text of unknown letters has no evidence and gets that one, at an equal share.
    Columns of docs called lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def measure():
        def measured(text: pa.Array) -> list[pa.Array]:
            names, score = shared.value.predict([t or "" for t in text.to_pylist()])
            return [pa.array(names, pa.string()), pa.array(score)]

        return measured

    return attach(docs, text_col, fields, measure, SLICE_BYTES, keep)
