"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, and L1 keeps most weights exactly zero, so
the trained model is a short list of (slot, weight) that is cheap to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import bounded_sample
from .shared import ID, TEXT, attach, stored, text_buffers
from .wordhash import LOWER, WORD_BYTES, mix, word_hashes

#: Labelled rows that training takes at most (a hash sample of them), hash bits, passes.
MAX_ROWS, SLOT_BITS, EPOCHS = 20_000, 20, 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 0.0
#: Multipliers that set the kinds of feature apart.
PAIR, SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words, word pairs and pairs that skip a word; and the row of each."""
    data, ends = text_buffers(text)
    words, owner = word_hashes(data, ends, WORD_BYTES, LOWER)
    slots, rows = [words], [owner]
    for gap, kind in ((1, PAIR), (2, SKIP)):
        if len(words) > gap:
            near = owner[gap:] == owner[:-gap]
            slots.append(mix(words[:-gap][near] * kind + words[gap:][near]))
            rows.append(owner[gap:][near])
    return (np.concatenate(slots) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.concatenate(rows)


def distinct_features(text: pa.Array) -> list[np.ndarray]:
    """Sorted distinct slots of each row."""
    slots, rows = features(text)
    both = np.unique((rows << SLOT_BITS) | slots)
    cuts = np.searchsorted(both, np.arange(1, len(text)) << SLOT_BITS)
    return [x & ((1 << SLOT_BITS) - 1) for x in np.split(both, cuts)]


@dataclass
class SparseModel:
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << SLOT_BITS, np.float32)
        table[self.slots] = self.weights
        return table


class Ftrl:
    """FTRL-proximal with per-coordinate rates (McMahan et al., 2013)."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << SLOT_BITS) + 1), np.zeros((1 << SLOT_BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, 1 << SLOT_BITS)  # the last coordinate is the bias
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        squared = gradient * gradient
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + squared) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + squared

    def model(self) -> SparseModel:
        w = self.weights(np.arange((1 << SLOT_BITS) + 1))
        slots = np.flatnonzero(w[:-1])
        return SparseModel(slots.astype(np.int32), w[slots].astype(np.float32), float(w[-1]))


def train_batches(epochs: int):
    """mapInArrow body over (slots, label) rows: one model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, int]] = []
        for batch in batches:
            lists, labels = batch.column(0), batch.column(1).to_pylist()
            rows += [(lists[i].values.to_numpy(), y) for i, y in enumerate(labels)]
        if not rows:
            return
        learner = Ftrl()
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                learner.step(*rows[k])
        model = learner.model()
        yield pa.RecordBatch.from_arrays([pa.array([model.slots], pa.list_(pa.int32())), pa.array([model.weights], pa.list_(pa.float32())), pa.array([model.bias])], ["slots", "weights", "bias"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_rows: int, seed: int) -> DataFrame:
    """(id, text, label) of a bounded hash sample of labelled rows, as a stored table.

    An id that repeats in docs counts once, with its smallest text; an id that has both labels
    counts once with each; ids without a document, and null ids, do not count."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias(ID), F.col(label_col).cast("int").alias("label")).distinct()
    chosen = F.broadcast(bounded_sample(known, ID, max_rows, seed))  # about max_rows rows of two numbers
    rows = docs.select(F.col(id_col).alias(ID), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(TEXT)).join(chosen, ID)
    rows = rows.groupBy(ID, "label").agg(F.min(TEXT).alias(TEXT)).select(ID, TEXT, "label")
    return stored(rows, "labelled")


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> SparseModel:
    """Fit on a bounded sample (max_rows) of the labelled rows, in one task.

    Null labels are left out; null texts count as empty.  Without labelled rows the model
    is empty and scores 0.5."""
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, max_rows, 11)

    def measure():
        def measured(text: pa.Array) -> list[pa.Array]:
            parts = [distinct_features(text.slice(k, 64)) for k in range(0, len(text), 64)]
            return [pa.array([f.astype(np.int32) for part in parts for f in part], pa.list_(pa.int32()))]

        return measured

    placed = sample.withColumn("place", F.xxhash64(ID, TEXT))
    coded = stored(attach(placed, TEXT, [T.StructField("slots", T.ArrayType(T.IntegerType()))], measure, keep=["place", "label"]), "features")
    ordered = coded.coalesce(1).sortWithinPartitions("place", "label", "slots").select("slots", "label")
    fitted = ordered.mapInArrow(train_batches(epochs), "slots array<int>, weights array<float>, bias double").first()
    if fitted is None:
        return SparseModel(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    return SparseModel(np.array(fitted["slots"], np.int32), np.array(fitted["weights"], np.float32), fitted["bias"])


def score_toxicity(docs: DataFrame, model: SparseModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with score (0 to 1), row by row: every distinct feature of the whole text counts once.

    Null and empty texts are scored by the bias alone.  A column called score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure():
        table, bias = shared.value.dense(), shared.value.bias

        def measured(text: pa.Array) -> list[pa.Array]:
            slots, rows = features(text)
            live = np.flatnonzero(table[slots])  # most weights are zero
            both = np.unique((rows[live] << SLOT_BITS) | slots[live])
            total = bias + np.bincount(both >> SLOT_BITS, table[both & ((1 << SLOT_BITS) - 1)], minlength=len(text))
            return [pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))]

        return measured

    return attach(docs, text_col, [T.StructField("score", T.DoubleType())], measure, keep=keep)
