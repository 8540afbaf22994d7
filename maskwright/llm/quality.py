"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is
described by how its words look (hashed word shapes, shares of capitals, digits
and signs, repetition) and encoded by a learned layer; gated attention

    a_k  ~  exp(w . (tanh(V h_k) * sigmoid(U h_k)))

weighs the encoded passages, and the weighted mean is scored.  All weights are
learned together from document labels alone.

Training takes at most ``SAMPLE_DOCS`` labelled documents (those with the least
hash of doc_id); scoring is one pass over all whole texts.

Defined cases: null or empty text is a bag of one empty passage and gets a
score; without labels of both kinds every score is 0.5; repeated ids are scored
each; labels other than 0 and 1 are ignored, of several labels of a document
the largest counts; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, in_portions, labelled_sample, remainder, texts_of, worker_memory

PASSAGE_WORDS = 64
SAMPLE_DOCS = 4000
SHAPES, STATS = 48, 10
FEATURES = SHAPES + STATS
HIDDEN, ATTENTION = 24, 12
THRESHOLD = 0.7
#: Words whose description one worker remembers, and words featurised at once.
CACHE_WORDS, PORTION = 300_000, 400_000

_RUNS = re.compile(r"(.)\1+", re.S)
_CLASS = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})


def _shape(word: str) -> str:
    """Letters as x or X, digits as 0, signs as they are, runs shortened to two."""
    if not word.isascii():
        word = "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1\1", word.translate(_CLASS))


@functools.lru_cache(4096)
def _bucket(shape: str) -> int:
    return xxhash.xxh32_intdigest(shape) % SHAPES


class PassageFeatures:
    """Texts -> rows of passage features and the document of each row."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, 7), np.float32)  # shape bucket, length, upper, digit, sign, all signs, long

    def _row(self, word: str) -> int:
        n = len(self.rows)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        size = len(word)
        if word.isalpha() and word[1:].islower():  # most words: letters, at most the first a capital
            upper = word[0].isupper()
            shape = ("X" if upper else "x") + "xx"[: size - 1]
            shape = _RUNS.sub(r"\1\1", shape)
            self.table[n] = (_bucket(shape), min(size, 40), upper / size, 0, 0, 0, size > 20)
            self.rows[word] = n
            return n
        upper = sum(c.isupper() for c in word)
        digit = sum(c.isdigit() for c in word)
        alpha = sum(c.isalpha() for c in word)
        sign = size - digit - alpha
        self.table[n] = (_bucket(_shape(word)), min(size, 40), upper / size, digit / size, sign / size, sign == size, size > 20)
        self.rows[word] = n
        return n

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.rows) > CACHE_WORDS:
            self.rows.clear()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = text.split()
            counts[k] = len(own)
            words += own
        bags = np.maximum(1, -(-counts // PASSAGE_WORDS))
        first = np.cumsum(bags) - bags
        owner = np.repeat(np.arange(len(texts)), bags)
        out = np.zeros((int(bags.sum()), FEATURES), np.float32)
        if not words:
            return out, owner
        rows = self.rows
        ids = np.fromiter((rows[w] if w in rows else self._row(w) for w in words), np.int64, len(words))
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        passage = np.repeat(first, counts) + place // PASSAGE_WORDS
        n, size = len(out), np.bincount(passage, minlength=len(out))
        got = self.table[ids]
        share = 1 / np.maximum(1, size)
        shapes = np.bincount(passage * SHAPES + got[:, 0].astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES)
        out[:, :SHAPES] = np.sqrt(shapes * share[:, None])
        for k in range(1, 7):
            out[:, SHAPES + k - 1] = np.bincount(passage, got[:, k], n) * share
        out[:, SHAPES] /= 10
        distinct = np.bincount(np.unique(passage * np.int64(1 << 32) + ids) >> 32, minlength=n)
        out[:, SHAPES + 6] = distinct * share
        same = (ids[1:] == ids[:-1]) & (passage[1:] == passage[:-1])
        out[:, SHAPES + 7] = np.bincount(passage[1:][same], minlength=n) * share
        out[:, SHAPES + 8] = np.minimum(size, PASSAGE_WORDS) / PASSAGE_WORDS
        out[:, SHAPES + 9] = size > 0
        return out, owner


def _features() -> PassageFeatures:
    return worker_memory("quality", PassageFeatures)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
    """Everything between features and scores; ``owner`` ascends and leaves no document out."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
    a = e / np.add.reduceat(e, starts)[owner]
    z = np.add.reduceat(h * a[:, None], starts)
    return {"starts": starts, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}


def fit(bags: list[tuple[np.ndarray, int]], epochs: int = 25, seed: int = 7) -> dict[str, np.ndarray] | None:
    """Weights by Adam on the cross-entropy of document labels; None without both labels."""
    labels = np.array([y for _, y in bags])
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    p = {
        "W": rng.normal(0, 0.3, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, ATTENTION)),
        "U": rng.normal(0, 0.2, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.2, ATTENTION), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1),
    }
    first, second, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    batch = 64
    epochs = max(epochs, -(-600 * batch // len(bags)))  # small samples get as many steps
    for _ in range(min(epochs, 400)):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            chosen = [bags[i] for i in order[lo : lo + batch]]
            x = np.concatenate([b for b, _ in chosen]).astype(float)
            y = np.array([v for _, v in chosen], float)
            owner = np.repeat(np.arange(len(chosen)), [len(b) for b, _ in chosen])
            f = forward(p, x, owner)
            d_out = (f["score"] - y) / len(y)
            d_z = d_out[:, None] * p["c"]
            h, a, t, g = f["h"], f["a"], f["t"], f["g"]
            d_a = (d_z[owner] * h).sum(1)
            d_e = a * (d_a - np.add.reduceat(a * d_a, f["starts"])[owner])
            d_tg = d_e[:, None] * p["w"]
            d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
            d_h = (d_z[owner] * a[:, None] + d_t @ p["V"].T + d_g @ p["U"].T) * (1 - h * h)
            grads = {"W": x.T @ d_h, "b": d_h.sum(0), "V": h.T @ d_t, "U": h.T @ d_g, "w": (t * g).T @ d_e, "c": f["z"].T @ d_out, "d": np.array([d_out.sum()])}
            step += 1
            for k, grad in grads.items():
                grad = grad + 1e-4 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                p[k] = p[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


def train(docs: DataFrame, labels: DataFrame, keep: Column, bound: int = SAMPLE_DOCS) -> dict[str, np.ndarray] | None:
    """A model from at most ``bound`` labelled documents that ``keep`` allows."""
    bounded_batches(docs.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _features()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = [features([t])[0].astype(np.float16).tobytes() for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": pa.array(out, pa.binary())})

    sample = labelled_sample(docs, labels, "quality", keep, bound)
    rows = sample.mapInArrow(describe, "doc_id long, label int, x binary").collect()  # at most `bound` documents' features
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    return fit([(np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES), r["label"]) for r in rows])


def score(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """``docs`` as doc_id, score and attention (place of the passage that weighs most)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _features()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores, top = np.full(len(texts), 0.5), np.zeros(len(texts), np.int32)
            for lo, hi in in_portions(map(len, texts), 6 * PORTION) if model else ():
                x, owner = features(texts[lo:hi])
                f = forward(model, x, owner)
                scores[lo:hi] = f["score"]
                order = np.lexsort((np.arange(len(owner)), -f["a"], owner))
                top[lo:hi] = order[f["starts"]] - f["starts"]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": scores, "top_passage": top})

    return texts_of(docs).mapInArrow(run, "doc_id long, score double, top_passage int")


def accepted(docs: DataFrame, model: dict[str, np.ndarray] | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without those that score below ``threshold``.  Without a model all stay."""
    if not model:
        return docs
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        features = _features()
        out = np.zeros(len(texts), bool)
        values = texts.fillna("").tolist()
        for lo, hi in in_portions(map(len, values), 6 * PORTION):
            out[lo:hi] = forward(model, *features(values[lo:hi]))["score"] >= threshold
        return pd.Series(out)

    return docs.where(good(F.col("text").cast("string")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all ``documents``; labels of every fourth hash value are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 4) != 2)
    scored = score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "top_passage")
