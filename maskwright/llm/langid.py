"""Language identification by nearest centroid.

A text becomes counts of its character bigrams and trigrams (letters in lower
case, anything else a blank) hashed into ``BUCKETS``, damped by a logarithm,
weighted by inverse document frequency and normalised.  Each language has
``CENTROIDS`` centroids from spherical k-means; a text gets the language of the
centroid nearest by cosine.  A text farther from that centroid than the
centroid's own radius is *rejected*: the operator then says ``und`` in
``accepted`` while ``lang`` keeps the nearest language.

Document frequencies come from all documents that may be learned from; the
centroids from at most ``SAMPLE_DOCS`` of each language (least hash of doc_id).

Defined cases: null texts and texts without a letter are ``und`` with score 0;
null languages are not learned from; without any language learned everything is
``und``; repeated ids are scored each; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, in_portions, remainder

BUCKETS = 4096
CENTROIDS = 4
SAMPLE_DOCS = 400
#: A centroid's radius: this quantile of its members' distances, and a margin.
RADIUS, MARGIN = 0.999, 0.1
UNKNOWN = "und"
_CHARS, _DOCS = 1_000_000, 512


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, by code point."""
    return np.array([chr(c).isalpha() for c in range(0x30000)], bool)


def counts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts (a row for each text) and whether a text has a letter."""
    joined = "".join(f" {t.lower()} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t.lower()) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    known = _letters()
    letter = known[np.minimum(codes, len(known) - 1)] | (codes >= len(known))
    has = np.bincount(owner, letter, len(texts)) > 0
    codes = np.where(letter, codes, 32).astype(np.uint32)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    pair = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)
    pair ^= pair >> np.uint32(15)
    triple = (pair + c * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    inside = (owner[2:] == owner[:-2]) & letter[1:-1]
    at = owner[1:-1][inside].astype(np.int64) * BUCKETS
    out = np.bincount(at + ((triple[inside] ^ (triple[inside] >> np.uint32(13))) * np.uint32(0x165667B1) >> shift), minlength=len(texts) * BUCKETS)
    out += np.bincount(at + (pair[inside] * np.uint32(0x27D4EB2F) >> shift), minlength=len(texts) * BUCKETS)
    return out.reshape(len(texts), BUCKETS), has


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    for lo, hi in in_portions(map(len, texts), _CHARS):
        for a in range(lo, hi, _DOCS):
            yield a, min(a + _DOCS, hi)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all these texts each bucket occurs, and how many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in _portions(texts):
                total += (counts_of(texts[lo:hi])[0] > 0).sum(0)
            n += len(texts)
        if n:
            yield pa.RecordBatch.from_pydict({"bucket": np.arange(-1, BUCKETS, dtype=np.int32), "n": np.r_[n, total]})

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:  # BUCKETS + 1 rows
        found[r["bucket"]] = r["n"]
    return found[:BUCKETS], int(found[BUCKETS])


def cluster(x: np.ndarray, k: int, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means, rows normalised."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:  # the farthest of a few
        tries = rng.choice(len(x), min(16, len(x)), replace=False)
        near = (x[tries] @ np.array(centres).T).max(1)
        centres.append(x[tries[near.argmin()]])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(k):
            if (own == j).any():
                m = x[own == j].sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-9)
    return c


def train(docs: DataFrame, keep: Column, bound: int = SAMPLE_DOCS) -> dict | None:
    """A model from the (doc_id, text, lang) rows that ``keep`` allows; at most ``bound`` texts of a language make centroids."""
    bounded_batches(docs.sparkSession)
    allowed = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in allowed.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    df, n = document_frequencies(allowed)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # a share of each language by hash first, so that no language is sorted as a whole
    limit = F.lit(0.0)
    for lang, size in sizes.items():
        limit = F.when(F.col("lang") == lang, min(1.0, 1.5 * bound / size + 20 / size)).otherwise(limit)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < limit

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _portions(texts):
                x, has = counts_of(texts[lo:hi])
                data = [v.astype(np.uint16).tobytes() if ok else None for v, ok in zip(np.minimum(x, 65535), has, strict=True)]
                yield pa.RecordBatch.from_pydict({"lang": batch.column("lang")[lo:hi], "h": batch.column("h")[lo:hi], "x": pa.array(data, pa.binary())})

    chosen = allowed.where(drawn).withColumn("h", F.xxhash64("doc_id"))
    rows = chosen.select("lang", "h", "text").mapInArrow(describe, "lang string, h long, x binary").where("x is not null").collect()
    rows.sort(key=lambda r: (r["h"], r["x"]))
    langs, centres, radii = [], [], []
    for lang in sorted({r["lang"] for r in rows}):
        own = [r["x"] for r in rows if r["lang"] == lang][:bound]
        x = weigh(np.array([np.frombuffer(v, np.uint16) for v in own]), idf)
        c = cluster(x, CENTROIDS)
        near = (x @ c.T).max(1)
        at = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (at == j).any():
                langs.append(lang)
                centres.append(c[j])
                radii.append(float(np.quantile(1 - near[at == j], RADIUS)) + MARGIN)
    if not langs:
        return None
    return {"idf": idf, "langs": langs, "centroids": np.array(centres, np.float32), "radii": np.array(radii)}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang (nearest), accepted (``und`` where rejected), score (cosine with the nearest centroid, 0 to 1)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lang, accepted, score = [UNKNOWN] * len(texts), [UNKNOWN] * len(texts), np.zeros(len(texts))
            for lo, hi in _portions(texts) if model else ():
                x, has = counts_of(texts[lo:hi])
                near = weigh(x, model["idf"]) @ model["centroids"].T
                best = near.argmax(1)
                top = np.clip(near[np.arange(hi - lo), best], 0, 1).astype(float)
                for k in np.flatnonzero(has):
                    lang[lo + k] = name = model["langs"][best[k]]
                    accepted[lo + k] = name if 1 - top[k] <= model["radii"][best[k]] else UNKNOWN
                    score[lo + k] = top[k]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": lang, "accepted": accepted, "score": score})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang string, accepted string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``; every fourth hash value is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, train(docs, remainder("doc_id", 4) != 2))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score", (F.col("accepted") == UNKNOWN).alias("rejected"))
