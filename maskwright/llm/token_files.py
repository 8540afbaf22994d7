"""Token-id files: one zstandard frame for each document, one dictionary for all.

A *shard* is a binary file::

    magic "MWTK1\\n" | header length u32 | header JSON | index | frames

The header holds the number of documents, the width of an id (2 or 4 bytes), the
SHA-256 of the dictionary and the sizes below.  The index has, for every
document in file order, its id (i64), the number of its tokens (u32) and where
its frame ends (u64, from the start of the frames).  A frame is a zstandard
frame over the ids as little-endian integers, compressed with the dictionary;
so one document is read with two short reads, without its neighbours.

The dictionary lies beside the shards as ``dictionary.zstd``.  It is trained on
at most ``sample_docs`` documents (``DICTIONARY_DOCS``), those with the least
hash of doc_id; all documents are written with it.

Shards hold disjoint ranges of doc_id in ascending order.  A task writes its
shard under a name of its own and moves it into place when complete, and the
manifest names the files of the attempts that Spark took, so a lost executor
leaves nothing but an unread file.

Defined cases: null text is the empty document (its end id alone); null doc_id
sorts first and is written as the flag value -2**63; repeated ids are all kept,
ordered by text hash and then text; an empty table gives no shard and no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, scratch_path, stored, texts_of
from .tokens import END_ID, ChunkEncoder, encoder_of, tokenizer_path

MAGIC = b"MWTK1\n"
#: Documents that the dictionary is trained on, and bytes of the dictionary.
DICTIONARY_DOCS = 400
DICTIONARY_BYTES = 32 << 10
NULL_ID = -(1 << 63)
TOKENIZER = "byte_bpe_50k.json"

INDEX = np.dtype([("doc_id", "<i8"), ("n_tokens", "<u4"), ("end", "<u8")])


def filesystem(uri: str):
    """The pyarrow file system and path of a URI; executors use it for the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else "file://" + uri)


def serialise(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary for serialised id arrays; empty where there is too little to learn from."""
    total = sum(map(len, arrays))
    if len(arrays) < 8 or total < 4 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:  # samples too uniform for a dictionary
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=1, write_checksum=False, **extra)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdDecompressor(**extra)


class Shard:
    """Random access to the documents of one shard file."""

    def __init__(self, uri: str, dictionary: bytes | None = None):
        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        if self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        (size,) = struct.unpack("<I", self.file.read(4))
        self.header = json.loads(self.file.read(size))
        if dictionary is None:
            with system.open_input_file(path.rpartition("/")[0] + "/dictionary.zstd") as f:
                dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != self.header["dictionary_sha256"]:
            raise ValueError(f"{uri} was written with another dictionary")
        self.index = np.frombuffer(self.file.read(self.header["n_docs"] * INDEX.itemsize), INDEX)
        self.frames_at = len(MAGIC) + 4 + size + len(self.index) * INDEX.itemsize
        self.decompressor = _decompressor(dictionary)
        self.dtype = "<u2" if self.header["width"] == 2 else "<u4"

    def ids(self, k: int) -> np.ndarray:
        """Token ids of the k-th document."""
        start = int(self.index["end"][k - 1]) if k else 0
        self.file.seek(self.frames_at + start)
        frame = self.file.read(int(self.index["end"][k]) - start)
        return self._decode(frame, k)

    def _decode(self, frame: bytes, k: int) -> np.ndarray:
        size = int(self.index["n_tokens"][k]) * self.header["width"]
        return np.frombuffer(self.decompressor.decompress(frame, max_output_size=size), self.dtype)

    def find(self, doc_id: int) -> list[int]:
        """Places of a document id; ids ascend within a file."""
        lo, hi = np.searchsorted(self.index["doc_id"], [doc_id, doc_id], "left")[0], np.searchsorted(self.index["doc_id"], doc_id, "right")
        return list(range(int(lo), int(hi)))

    def scan(self) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in order, read straight through."""
        self.file.seek(self.frames_at)
        start = 0
        for k, (doc_id, _, end) in enumerate(self.index.tolist()):
            yield doc_id, self._decode(self.file.read(end - start), k)
            start = end


def write_tokens(
    docs: DataFrame,
    out: str,
    tokenizer: str | None = None,
    word_ends: bool = False,
    partitions: int | None = None,
    sample_docs: int = DICTIONARY_DOCS,
) -> DataFrame:
    """Encode all documents and write them below ``out`` (a URI in a shared folder).

    Returns the manifest: shard, file, n_docs, n_tokens, n_bytes, first_id.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path(TOKENIZER)
    bounded_batches(spark)
    rows = texts_of(docs)
    system, folder = filesystem(out)
    system.create_dir(folder, recursive=True)

    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    picked = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    encoder = ChunkEncoder(tokenizer, word_ends)
    sample = rows.join(F.broadcast(picked), "doc_id").toLocalIterator()  # one document at a time
    arrays = []
    for row in sample:
        ids = np.append(np.frombuffer(encoder.encode(row["text"]), "<u4"), END_ID)
        arrays.append(serialise(ids, width))
    dictionary = train_dictionary(arrays)
    del arrays, encoder
    with system.open_output_stream(f"{folder}/dictionary.zstd") as f:
        f.write(dictionary)
    digest = hashlib.sha256(dictionary).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press = encoder_of(tokenizer, word_ends), _compressor(dictionary)
        end = serialise(np.array([END_ID]), 4)
        index, frames, at, n_tokens = [], [], 0, 0
        name = f"{uuid.uuid4().hex}.mwtk"
        there, where = filesystem(out)
        part = f"{where}/_{name}.frames"
        stream = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = own.encode(text) + end
                frame = press.compress(raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes())
                stream = stream or there.open_output_stream(part)
                stream.write(frame)
                at += len(frame)
                n_tokens += len(raw) // 4
                index.append((NULL_ID if doc_id is None else doc_id, len(raw) // 4, at))
        if not index:
            return
        stream.close()
        table = np.array(index, INDEX)
        header = json.dumps({"n_docs": len(table), "width": width, "dictionary_sha256": digest, "end_id": END_ID, "frames": at}).encode()
        with there.open_output_stream(f"{where}/_{name}") as whole:
            whole.write(MAGIC + struct.pack("<I", len(header)) + header + table.tobytes())
            with there.open_input_file(part) as source:
                while piece := source.read(4 << 20):
                    whole.write(piece)
        there.move(f"{where}/_{name}", f"{where}/{name}")
        there.delete_file(part)
        yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(table)], "n_tokens": [n_tokens], "n_bytes": [at], "first_id": [index[0][0]]}, schema)

    schema = pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("first_id", pa.int64())])
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        rows.withColumn("h", F.xxhash64("text"))
        .repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), "h")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
        .select("doc_id", "text")
    )
    manifest = ordered.mapInArrow(encode, "file string, n_docs long, n_tokens long, n_bytes long, first_id long")
    # a task's number is that of its range
    return stored(manifest.select(F.spark_partition_id().alias("shard"), "*"), "manifest")


def read_tokens(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before), n_tokens, ids (binary, unsigned 32-bit).

    The starts come from the manifest's running total, a row for each shard.
    """
    return _read(spark, out, manifest, "ids binary", pa.field("ids", pa.binary()), lambda ids: ids.astype("<u4").tobytes())


def read_digests(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """As ``read_tokens`` with the crc32 of the ids in place of them."""
    return _read(spark, out, manifest, "ids_crc32 long", pa.field("ids_crc32", pa.int64()), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark, out, manifest, column, field, value) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), field])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, start, size = [], before, 0
                for doc_id, ids in Shard(f"{out}/{name}").scan():
                    found.append((None if doc_id == NULL_ID else doc_id, start, len(ids), value(ids)))
                    start += len(ids)
                    size += len(ids)
                    if len(found) >= 2000 or size > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    order = Window.orderBy("shard")  # a row for each shard, not for each document
    starts = manifest.select("shard", "file", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("before"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = starts.select("file", "before", "shard").repartition(shards, "file").select("file", "before")
    return dealt.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {column}")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``documents`` as token files and describe each from what is read back."""
    out = scratch_path(spark, "tokens")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    return read_digests(spark, out, manifest)
