"""Token ids on disk, bit-packed at fixed width, with block offsets for random access.

A shard file, all numbers little-endian:

    magic "GLIDPK01"
    blocks             each BLOCK ids (the last may be shorter), every id in `bits` bits,
                       low bits first, padded to whole bytes
    block offsets      uint64 per block: its first byte in the file
    document ids       int64 per document, ascending, nulls first
    null flags         uint8 per document: 1 if the id is null
    document ends      uint64 per document: ids of the shard up to its end
    footer             uint64 x 6: bits, BLOCK, documents, ids, blocks, byte of the block offsets

A folder of shards is in ascending order of document id; the manifest says how many
ids each shard holds, so the place of every document in the whole is known.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import drops_case, splits_at_spaces, word_parts
from .shared import ID, id_text, scratch, slices, small_arrow_batches, stored

MAGIC, FOOTER = b"GLIDPK01", struct.Struct("<6Q")
BLOCK = 1 << 16
#: Most shards of one folder; their bounds and manifest are held on the driver.
MAX_SHARDS = 10_000
CACHED_WORDS = 700_000
NUL = "\x00"
T_ = TypeVar("T_")
MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def width(vocabulary: int) -> int:
    """Fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    octets = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(octets.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    octets = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return np.packbits(np.pad(octets, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


class ShardWriter:
    """Streams documents into one shard; holds one block of ids and 17 bytes a document."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.bits, self.block, self.at, self.total = bits, block, len(MAGIC), 0
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.offsets: list[int] = []
        self.docs: list[int | None] = []
        self.ends: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.total += len(ids)
        self.ends.append(self.total)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block * self.block
            for a in range(0, whole, self.block):
                self.flush(ids[a : a + self.block])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def flush(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        """Finish the file and move it to its name, so that a retried task leaves one whole shard."""
        if self.held:
            self.flush(np.concatenate(self.waiting))
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array(self.ends, "<u8").tobytes())
        self.out.write(FOOTER.pack(self.bits, self.block, len(self.docs), self.total, len(self.offsets), self.at))
        self.out.close()
        self.fs.move(self.part, self.path)


class ShardReader:
    """Random access to one shard: documents by position, ids by range."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a shard of packed ids: {uri}")
        self.bits, self.block, self.n_docs, self.n_ids, blocks, at = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        tail = self.file.read_at(size - FOOTER.size - at, at)
        self.offsets = np.frombuffer(tail, "<u8", blocks)
        self.doc_ids = np.frombuffer(tail, "<i8", self.n_docs, 8 * blocks)
        self.null = np.frombuffer(tail, np.uint8, self.n_docs, 8 * (blocks + self.n_docs)).astype(bool)
        self.ends = np.frombuffer(tail, "<u8", self.n_docs, 8 * blocks + 9 * self.n_docs).astype(np.int64)

    def block_ids(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        return unpack(self.file.read_at(-(-n * self.bits // 8), int(self.offsets[k])), self.bits, n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the shard; only the blocks that hold them are read."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        return np.concatenate([self.block_ids(k) for k in range(first, last + 1)])[start - first * self.block : end - first * self.block]

    def document(self, position: int) -> np.ndarray:
        return self.ids(int(self.ends[position - 1]) if position else 0, int(self.ends[position]))

    def documents(self, step: int = 16) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last, ids) of consecutive documents, at least `step` blocks of ids at a time."""
        first = 0
        while first < self.n_docs:
            start = int(self.ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(self.ends, start + step * self.block, side="right")))
            yield first, last, self.ids(start, int(self.ends[last - 1]))
            first = last


# ---- encoding -----------------------------------------------------------------


class LibraryEncoder:
    """The tokenizers library over whole texts, remembering each word between ASCII white space.

    Pre-tokenizers that drop white space never join text across it, so a text's ids are
    its words' ids in order; other files are encoded text by text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.by_word, self.lowers = splits_at_spaces(self.library), drops_case(self.library)
        tokenize = self.library.model.tokenize
        #: whether lower-case ASCII words go to the model as they are
        self.direct = self.lowers and all([t.id for t in tokenize(w)] == self.library.encode(w, add_special_tokens=False).ids for w in ("a", "the", "wordlike", "qzxv"))
        mark = self.library.encode(NUL, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.words: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encode many words in few calls: a NUL, one token of its own, marks where each ends."""
        if self.direct:
            tokenize, rest = self.library.model.tokenize, []
            for w in words:
                if w.isascii() and w.isalpha() and w.islower():
                    self.words[w] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(w)])
                else:
                    rest.append(w)
            words = rest
        odd = [w for w in words if self.mark is None or NUL in w]
        for word, coded in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.words[word] = np.array(coded.ids, "<u4").tobytes()
        plain = [w for w in words if self.mark is not None and NUL not in w]
        for at in range(0, len(plain), 128):
            part = plain[at : at + 128]
            ids = np.array(self.library.encode_batch_fast([f" {NUL} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(part) - 1:
                raise ValueError("the vocabulary joins NUL to other characters")
            data, starts, ends = ids.tobytes(), [0, *(4 * marks + 4).tolist()], [*(4 * marks).tolist(), 4 * len(ids)]
            self.words.update((w, data[a:b]) for w, a, b in zip(part, starts, ends, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return self.over_words(texts, b"".join)

    def lengths(self, texts: list[str]) -> list[int]:
        """Number of ids of each text."""
        if not self.by_word:
            return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return self.over_words(texts, lambda coded: sum(map(len, coded)) // 4)

    def over_words(self, texts: list[str], combine: Callable[[Iterable[bytes]], T_]) -> list[T_]:
        """combine() over the ids of each text's words."""
        split = [word_parts(t, self.lowers) for t in texts]
        new = list(set().union(*split).difference(self.words))
        full = len(self.words) + len(new) > CACHED_WORDS
        self.learn(new)
        known = self.words.__getitem__
        out = [combine(map(known, words)) for words in split]
        if full:  # what was met first stays; the rest is forgotten at once
            for word in new:
                del self.words[word]
        return out


@cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def encode_batches(path: str, bounds: list[int], end_id: int | None, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, cuts = encoder(path), np.array(bounds, np.int64)
        end = np.array([] if end_id is None else [end_id], "<u4")
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            coded = [np.append(np.frombuffer(c, "<u4"), end) for c in coder.encode(batch.column(1).to_pylist())]
            ids = batch.column(0)
            shard = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, ids.fill_null(0).to_numpy(), side="left"))
            packed = [squeeze(pack(c, bits)) for c in coded]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), ids, pa.array(list(map(len, coded)), pa.int64()), pa.array(packed, pa.binary())], ["shard", ID, "n", "packed"])

    return run


def write_batches(folder: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, open_, done = None, -1, []
        loosen = zstandard.ZstdDecompressor().decompress

        def finish() -> None:
            if writer is not None:
                writer.close()
                done.append((open_, f"{folder}/{open_:06d}.ids", len(writer.docs), writer.total))

        for batch in batches:
            for shard, doc, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != open_:
                    finish()
                    writer, open_ = ShardWriter(f"{folder}/{shard:06d}.ids", bits), shard
                writer.add(doc, unpack(loosen(packed), bits, n))
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], MANIFEST.names)

    return run


def write_ids(docs: DataFrame, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode docs with the tokenizers library and write packed shards; returns their manifest.

    Documents are in ascending order of their integer id over all shards, null ids first,
    rows with equal ids by their ids' bytes.  Null texts count as empty.  end_id, if given,
    follows each document.  The shards go to `folder`, else to a new scratch folder.
    An empty table gives no shard and an empty manifest.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    rows = id_text(docs, id_col, text_col).withColumn(ID, F.col(ID).cast("long"))
    bits = width(encoder(path).size)
    shards = min(MAX_SHARDS, docs.rdd.getNumPartitions())
    cuts = [i / shards for i in range(1, shards)]
    bounds = (rows.select(F.percentile_approx(ID, cuts, 10 * shards).alias("b")).first()["b"] or []) if cuts else []
    folder = folder or scratch(spark, "packed-ids")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField(ID, T.LongType()), T.StructField("n", T.LongType()), T.StructField("packed", T.BinaryType())])
    coded = rows.mapInArrow(encode_batches(path, sorted(set(bounds)), end_id, bits), schema)
    ordered = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col(ID).asc_nulls_first(), "packed")
    return stored(ordered.mapInArrow(write_batches(folder, bits), MANIFEST), "manifest")


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            reader = ShardReader(path)
            for first, last, ids in reader.documents():
                ends = reader.ends[first:last]
                before = int(reader.ends[first - 1]) if first else 0
                starts = np.concatenate([[before], ends[:-1]])
                offsets = pa.array(4 * np.concatenate([[0], ends - before]), pa.int32())
                packed = pa.Array.from_buffers(pa.binary(), last - first, [None, offsets.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
                doc = pa.array(reader.doc_ids[first:last], pa.int64(), mask=reader.null[first:last])
                yield pa.RecordBatch.from_arrays([doc, pa.array(base + starts), pa.array(ends - starts), packed], ["doc_id", "start", "n_tokens", "ids"])


def read_ids(spark: SparkSession, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of a folder of shards: id, start (ids of all documents before), n_tokens, ids (packed uint32)."""
    shards = manifest.orderBy("shard").collect()  # at most MAX_SHARDS rows
    base, rows = 0, []
    for shard in shards:
        rows.append((shard["path"], base))
        base += shard["n_ids"]
    places = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return places.mapInArrow(read_batches, "doc_id long, start long, n_tokens long, ids binary").withColumnRenamed("doc_id", id_col)
