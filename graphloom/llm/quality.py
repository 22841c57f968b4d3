"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a vector of hashed term weights: its words, the shapes of its tokens, and
tokens that repeat the one before.  A truncated SVD of a bounded labelled sample gives
the latent space.  The labelled vectors are broadcast; every document's cosines with
all of them are computed exactly, a block of documents at a time, and the labels of
the nearest ones are weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ID, TEXT, attach, stored, text_buffers
from .toxicity import labelled_sample
from .wordhash import LOWER, PLAIN, TOKEN_BYTES, WORD_BYTES, run_hashes, runs, word_hashes

#: Labelled rows used at most (a hash sample), terms for shapes and for words, latent dimensions, voters.
MAX_ROWS, SHAPES, WORDS, LATENT, NEIGHBOURS = 4_096, 512, 1_536, 48, 25
#: Documents whose cosines are computed at once.
BLOCK = 512
#: Cosines are raised to this power before voting.
SHARPNESS = 4

#: Shape classes of bytes: upper case, lower case (non-ASCII included), digits; others as they are.
SHAPE = PLAIN.copy()
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 65, 97, 97, 48


def counts(text: pa.Array) -> np.ndarray:
    """Term counts of each row: shapes and repeats first, then words."""
    data, ends = text_buffers(text)
    data, ends = data[ends[0] : ends[-1]], ends - ends[0]
    rows = len(text)
    start, end = runs(data, ends, TOKEN_BYTES)
    owner = np.searchsorted(ends, start, side="right") - 1
    token = run_hashes(data, start, end)
    again = np.flatnonzero((token[1:] == token[:-1]) & (owner[1:] == owner[:-1])) + 1
    # a shape is a token's byte classes with runs of one class taken once
    shape = SHAPE[data]
    first = np.zeros(len(data), bool)
    if len(start):
        first[1:] = shape[1:] != shape[:-1]
        first[start] = True
        first &= TOKEN_BYTES[data]
        place = np.cumsum(first)
        shapes = run_hashes(shape[first], place[start] - 1, place[end - 1])
    else:
        shapes = np.zeros(0, np.uint64)
    word, word_owner = word_hashes(data, ends, WORD_BYTES, LOWER)
    width = SHAPES + WORDS
    cells = [owner * width + 1 + (shapes % np.uint64(SHAPES - 1)).astype(np.int64), owner[again] * width, word_owner * width + SHAPES + (word % np.uint64(WORDS)).astype(np.int64)]
    return np.bincount(np.concatenate(cells), minlength=rows * width).reshape(rows, width).astype(np.float32)


def weighted(terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts as shares of the text, shapes and words each to unit length."""
    out = np.log1p(terms) * idf
    for part in (out[:, :SHAPES], out[:, SHAPES:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return out


@dataclass
class LatentModel:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        latent = weighted(terms, self.idf) @ self.basis
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def vote(self, terms: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors.

        Texts without a place in the latent space get the share of label 1 among all of them.
        Of equally near vectors at the edge of the circle the first in order are taken."""
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        latent = self.project(terms)
        cosines = latent @ self.vectors.T
        best = nearest(cosines, min(NEIGHBOURS, len(self.labels)))
        weight = np.maximum(np.take_along_axis(cosines, best, 1), 1e-6).astype(np.float64) ** SHARPNESS
        return np.where(latent.any(1), (weight * self.labels[best]).sum(1) / weight.sum(1), self.labels.mean())


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row; ties at the k-th go to the first columns."""
    best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(cosines, best, 1).min(1, keepdims=True)
    tied = np.flatnonzero(np.count_nonzero(cosines >= edge, axis=1) > k)
    if len(tied):
        above, ties = cosines[tied] > edge[tied], cosines[tied] == edge[tied]
        left = k - np.count_nonzero(above, axis=1)[:, None]
        best[tied] = np.nonzero(above | ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= left))[1].reshape(len(tied), k)
    return best


def fit(terms: np.ndarray, labels: np.ndarray, latent: int = LATENT) -> LatentModel:
    seen = (terms > 0).sum(0)
    idf = np.log((1 + len(terms)) / (1 + seen)).astype(np.float32) + 1
    matrix = weighted(terms, idf)
    _, vectors = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    model = LatentModel(idf, np.ascontiguousarray(vectors[:, ::-1][:, :latent]).astype(np.float32), np.zeros((0, latent), np.float32), labels.astype(np.float32))
    model.vectors = model.project(terms)
    return model


def fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (terms, label) rows: one model, its arrays as bytes."""
    terms, labels = [], []
    for batch in batches:
        raw = batch.column(0).to_pylist()
        terms.append(np.frombuffer(b"".join(raw), "<f4").reshape(len(raw), SHAPES + WORDS))
        labels += batch.column(1).to_pylist()
    if labels:
        model = fit(np.concatenate(terms), np.array(labels))
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (model.idf, model.basis, model.vectors, model.labels)], ["idf", "basis", "vectors", "labels"])


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> LatentModel:
    """Fit on a bounded sample (max_rows) of the labelled rows; the model has at most that many vectors.

    Null labels are left out; null texts count as empty.  Without labelled rows every score is 0.5."""
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, max_rows, 13)

    def measure():
        def measured(text: pa.Array) -> list[pa.Array]:
            rows = [r.tobytes() for k in range(0, len(text), BLOCK) for r in counts(text.slice(k, BLOCK)).astype("<f4")]
            return [pa.array(rows, pa.binary())]

        return measured

    placed = sample.withColumn("place", F.xxhash64(ID, TEXT))
    coded = stored(attach(placed, TEXT, [T.StructField("terms", T.BinaryType())], measure, keep=["place", "label"]), "terms")
    ordered = coded.coalesce(1).sortWithinPartitions("place", "label").select("terms", "label")
    fitted = ordered.mapInArrow(fit_batches, "idf binary, basis binary, vectors binary, labels binary").first()
    width = SHAPES + WORDS
    if fitted is None:
        return LatentModel(np.ones(width, np.float32), np.zeros((width, LATENT), np.float32), np.zeros((0, LATENT), np.float32), np.zeros(0, np.float32))
    idf, basis, vectors, known = (np.frombuffer(bytes(x), "<f4") for x in fitted)
    return LatentModel(idf, basis.reshape(width, -1), vectors.reshape(len(known), -1), known)


def score_quality(docs: DataFrame, model: LatentModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with score (0 to 1), row by row.

    Null and empty texts have no terms: they get the share of label 1 among the labelled rows.
    Labelled vectors are in an order of their own (a hash of id and text, then label), which
    decides between equally near ones.  A column called score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure():
        model = shared.value

        def measured(text: pa.Array) -> list[pa.Array]:
            scores = [model.vote(counts(text.slice(k, BLOCK))) for k in range(0, len(text), BLOCK)]
            return [pa.array(np.concatenate(scores).astype(np.float64))]

        return measured

    return attach(docs, text_col, [T.StructField("score", T.DoubleType())], measure, keep=keep)
