"""Vectors of words in their sentence, looked up in a cache of encoded sentences.

Sentences are encoded in batches of about equal length, padded to the longest of their
batch, each distinct sentence once.  The cache is a Parquet table of keys (the sentence's md5)
and vectors in single precision, one after the other; what it lacks is found by an anti-join, encoded and
appended, so a second run over the same sentences encodes none.  An encoder is anything that turns
padded rows of words and their lengths into an array of (sentence, place, component).

Defined cases: sentences whose words differ only in where spaces lie share an entry; a
sentence without words has no entry and an empty matrix; null sentences are passed over;
a lookup that the cache cannot answer is an error; looking up a single word is an error.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import ship

#: Sentences of a batch, and words whose vectors an encoder remembers.
BATCH, REMEMBERED = 64, 200_000
Encoder = Callable[[list[list[str]], list[int]], np.ndarray]


def hashed_word(word: str, size: int) -> np.ndarray:
    """Sixteenths from -0.5 on by the hexadecimal digits of the word's md5, repeated as often as needed."""
    digits = hashlib.md5(word.encode()).hexdigest()
    return np.array([int(digits[i % 32], 16) / 16 - 0.5 for i in range(size)])


class _Places(dict):
    """word -> row of ``vectors``; the empty word has zeros in row 0."""

    def __init__(self, size: int):
        super().__init__({"": 0})
        self.size, self.vectors = size, np.zeros((1024, size))

    def __missing__(self, word: str) -> int:
        place = len(self)
        if place == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[place] = hashed_word(word, self.size)
        self[word] = place
        return place


_places: dict[int, _Places] = {}


@dataclass(frozen=True)
class NeighbourEncoder:
    """A small encoder that needs no model: half a word's own hashed vector and a quarter of each neighbour's."""

    size: int = 8

    def __call__(self, rows: list[list[str]], lengths: list[int]) -> np.ndarray:
        known = _places.get(self.size)
        if known is None or len(known) > REMEMBERED:
            known = _places[self.size] = _Places(self.size)
        most = max(lengths)
        at = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(rows)), np.int64, len(rows) * most).reshape(len(rows), most)
        at[np.arange(most) >= np.array(lengths)[:, None]] = 0
        own = np.zeros((len(rows), most + 2, self.size))
        own[:, 1:-1] = known.vectors[at]
        return own[:, 1:-1] / 2 + own[:, :-2] / 4 + own[:, 2:] / 4


def pad(rows: list[list[str]]) -> tuple[list[list[str]], list[int]]:
    """Rows with empty words behind up to the longest, and their lengths."""
    lengths = [len(r) for r in rows]
    return [[*r, *[""] * (max(lengths) - n)] for r, n in zip(rows, lengths, strict=True)], lengths


def encoded(sentences: DataFrame, encode: Encoder, batch: int = BATCH) -> DataFrame:
    """key, size, vectors of every row of ``sentences`` (key, words): ``size`` components for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            if not some.num_rows:
                continue
            words = some.column("words").to_pylist()
            # neighbours have about one length, so little of a batch is padding
            order = np.argsort([len(w) for w in words], kind="stable")
            found = []
            for start in range(0, len(order), batch):
                rows, lengths = pad([words[i] for i in order[start : start + batch]])
                values = np.asarray(encode(rows, lengths), np.float32)
                found.append(values[np.arange(values.shape[1]) < np.array(lengths)[:, None]])
            size = found[0].shape[1]
            ends = np.concatenate([[0], np.cumsum([len(words[i]) * size for i in order])]).astype(np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).ravel()))
            yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(order)), pa.array(np.full(len(order), size, np.int32)), vectors], names=["key", "size", "vectors"])

    ship(sentences.sparkSession)
    return sentences.select("key", "words").mapInArrow(run, _CACHED)


_CACHED = "key binary, size int, vectors array<float>"


def _key(words: str | Column) -> Column:
    return F.unhex(F.md5(F.array_join(words, " ")))


def _matrices(cached: DataFrame) -> DataFrame:
    """key, matrix: a row for each word."""
    rows = F.transform(F.sequence(F.lit(0), (F.size("vectors") / F.col("size") - 1).cast("int")), lambda i: F.slice("vectors", i * F.col("size") + 1, F.col("size")))
    return cached.select("key", rows.alias("matrix"))


@dataclass(frozen=True)
class SentenceCache:
    """Encoded sentences below ``path``."""

    path: str
    encode: Encoder
    batch: int = BATCH

    def table(self, spark: SparkSession) -> DataFrame | None:
        """key, size, vectors; None before anything was encoded."""
        try:
            return spark.read.schema(_CACHED).parquet(self.path)
        except AnalysisException:
            return None

    def fill(self, sentences: DataFrame, words: str = "words") -> int:
        """Encode what the cache lacks of ``sentences`` and append it; the number of sentences encoded."""
        spark = sentences.sparkSession
        wanted = sentences.where(F.size(words) > 0).select(_key(words).alias("key"), F.col(words).alias("words"))
        wanted = wanted.groupBy("key").agg(F.first("words").alias("words"))
        cache = self.table(spark)
        if cache is not None:
            wanted = wanted.join(cache.select("key"), "key", "left_anti")
        before = 0 if cache is None else cache.count()
        encoded(wanted, self.encode, self.batch).write.mode("append").parquet(self.path)
        return self.table(spark).count() - before

    def lookup(self, sentences: DataFrame, words: str = "words", made: Callable[[DataFrame], DataFrame] = _matrices) -> DataFrame:
        """``sentences`` with ``matrix``, a row for each word; or with what ``made`` makes of key, size and vectors as key and one more column.

        ``made`` works where the cache lies: what is wanted of the vectors alone meets the sentences, not the vectors.
        """
        cache = self.table(sentences.sparkSession)
        if cache is None:
            raise ValueError(f"no sentence is encoded below {self.path}")
        hit = made(cache)
        name, kind = next((f.name, f.dataType) for f in hit.schema.fields if f.name != "key")
        hit = hit.select(F.col("key").alias("_key"), F.struct(name).alias("_hit"))
        own = sentences.withColumn("_own", _key(words))
        found = own.join(hit, F.col("_own") == F.col("_key"), "left")
        miss = F.raise_error(F.concat(F.lit("not in the cache: "), F.array_join(words, " "))).cast(kind)
        empty = F.array().cast(kind) if name == "matrix" else F.lit(None).cast(kind)
        return found.select(*sentences.columns, F.when(F.size(words) == 0, empty).when(F.col("_hit").isNull() & F.col(words).isNotNull(), miss).otherwise(F.col(f"_hit.{name}")).alias(name))

    def lookup_word(self, word: str | Column) -> DataFrame:
        raise TypeError(f"{word!r}: a word has a vector in its sentence only; look sentences up")


def weighted_sums(cached: DataFrame, by_place: float = 1.0, by_component: float = 10.0) -> DataFrame:
    """key, weighted: all components of a sentence added up, each times ``by_place`` for its word's place from 1 on plus ``by_component`` for its own from 0 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vectors")
            ends = vectors.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(ends)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - (ends[:-1] - ends[0])[row]
            word, component = np.divmod(place, np.maximum(batch.column("size").to_numpy(), 1)[row])
            total = np.bincount(row, vectors.flatten().to_numpy().astype(float) * (by_place * (word + 1) + by_component * component), len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(total)], names=["key", "weighted"])

    ship(cached.sparkSession)
    return cached.mapInArrow(run, "key binary, weighted double")
