"""Toxicity: a factorization machine over hashed terms.

The terms of a text are its distinct words in lower case and the words' first
four letters, hashed into ``BUCKETS``.  The score is

    sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)

so a pair of terms can weigh more (or less) than both alone: an insult beside
the mention of a group, say, which additive weights miss.  Terms in fewer than
``MIN_DOCS`` training texts carry no weight, nor do those whose share of texts differs
between the labels by less than ``SCREEN`` standard errors: else the many chance terms
of a long text add up.

The settings come from ``tune_toxicity``, which knows nothing of held-out rows.

Training takes at most ``SAMPLE_DOCS`` labelled documents (those with the least
hash of doc_id); scoring is one pass over all whole texts.

Defined cases: null or empty text has no terms and gets the score of the bias;
without labels of both kinds every score is 0; repeated ids are scored each;
labels other than 0 and 1 are ignored, of several labels of a document the
largest counts; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, in_portions, labelled_sample, remainder, texts_of, worker_memory

BITS = 18
BUCKETS = 1 << BITS
FACTORS = 6
SAMPLE_DOCS = 6000
MIN_DOCS, SCREEN = 3, 4.5
PREFIX = 4
THRESHOLD = 0.5
#: AdaGrad's rate, L1 penalties, and what an error on a toxic text weighs.
RATE, L1_LINEAR, L1_FACTORS, TOXIC_WEIGHT = 0.3, 0.0, 0.005, 2.0
#: Spread of the factors before training.
START = 0.05
CACHE_WORDS, PORTION = 300_000, 3_000_000
_EDGES = ".,;:!?\"'()[]{}*#&%$<>|-"


class Terms(dict):
    """word as written -> its two term numbers in one integer."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        plain = word.lower().strip(_EDGES)
        if plain:
            a = xxhash.xxh64_intdigest(plain) & (BUCKETS - 1)
            b = xxhash.xxh64_intdigest(plain[:PREFIX], 1) & (BUCKETS - 1)
            value = (a << BITS) | b
        else:
            value = -1
        self[word] = value
        return value

    def of(self, texts: list[str], active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, term) pairs, as two arrays ordered by text; only active terms if given."""
        split = [t.split() for t in texts]
        n = sum(map(len, split))
        both = np.fromiter((self[w] for s in split for w in s), np.int64, n)
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        keep = both >= 0
        both, owner = both[keep], owner[keep]
        ids = np.r_[both >> BITS, both & (BUCKETS - 1)]
        owner = np.r_[owner, owner]
        if active is not None:
            keep = active[ids]
            ids, owner = ids[keep], owner[keep]
        pairs = np.unique(owner << BITS | ids)
        return pairs >> BITS, pairs & (BUCKETS - 1)


def logits(model: dict, n: int, owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and sums of factors, of ``n`` texts."""
    v = model["V"][ids]
    sums = np.stack([np.bincount(owner, v[:, f], n) for f in range(FACTORS)], 1)
    squares = np.bincount(owner, (v * v).sum(1), n)
    return model["w0"] + np.bincount(owner, model["w"][ids], n) + 0.5 * ((sums * sums).sum(1) - squares), sums


def _shrunk(value: np.ndarray, grad: np.ndarray, step: np.ndarray, l1: float) -> np.ndarray:
    """A gradient step, then towards zero by the L1 penalty: terms that tell nothing weigh nothing."""
    value = value - step * grad
    return np.sign(value) * np.maximum(np.abs(value) - step * l1, 0)


def fit(docs: list[tuple[np.ndarray, int]], epochs: int = 8, seed: int = 5) -> dict | None:
    """A machine by AdaGrad on the cross-entropy; None without both labels."""
    labels = np.array([y for _, y in docs], float)
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, BUCKETS), np.int64)
    for ids, y in docs:
        seen[y, ids] += 1
    n = np.array([[len(labels) - labels.sum()], [labels.sum()]])
    share = seen.sum(0) / n.sum()
    error = np.sqrt(share * (1 - share) * (1 / n).sum())
    active = (seen.sum(0) >= MIN_DOCS) & (np.abs(seen[1] / n[1] - seen[0] / n[0]) >= SCREEN * error) & (error > 0)
    model = {"w0": -2.0, "w": np.zeros(BUCKETS), "V": rng.normal(0, START, (BUCKETS, FACTORS)), "active": active}
    model["V"][~model["active"]] = 0
    data = [ids[model["active"][ids]] for ids, _ in docs]
    g0, gw, gv = 1e-3, np.full(BUCKETS, 0.3), np.full((BUCKETS, FACTORS), 0.3)
    batch = 64
    epochs = min(60, max(epochs, -(-500 * batch // len(docs))))  # small samples get as many steps
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            ids = np.concatenate([data[i] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(data[i]) for i in chosen])
            z, sums = logits(model, len(chosen), owner, ids)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) * np.where(labels[chosen] == 1, TOXIC_WEIGHT, 1.0)
            terms, at = np.unique(ids, return_inverse=True)
            grad = np.bincount(at, d[owner], len(terms))
            gw[terms] += grad * grad
            model["w"][terms] = _shrunk(model["w"][terms], grad, RATE / np.sqrt(gw[terms]), L1_LINEAR)
            each = d[owner][:, None] * (sums[owner] - model["V"][ids])
            grads = np.stack([np.bincount(at, each[:, f], len(terms)) for f in range(FACTORS)], 1)
            gv[terms] += grads * grads
            model["V"][terms] = _shrunk(model["V"][terms], grads, 0.1 * RATE / np.sqrt(gv[terms]), L1_FACTORS)
            g0 += d.sum() ** 2
            model["w0"] -= RATE * d.sum() / np.sqrt(g0)
    model["V"], model["w"] = model["V"].astype(np.float32), model["w"].astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, keep: Column, bound: int = SAMPLE_DOCS) -> dict | None:
    """A machine from at most ``bound`` labelled documents that ``keep`` allows."""
    bounded_batches(docs.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            out = [terms.of([t])[1].astype(np.uint32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "ids": pa.array(out, pa.binary())})

    sample = labelled_sample(docs, labels, "toxic", keep, bound)
    rows = sample.mapInArrow(describe, "doc_id long, label int, ids binary").collect()  # terms of at most `bound` documents
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["ids"])))
    return fit([(np.frombuffer(r["ids"], np.uint32).astype(np.int64), r["label"]) for r in rows])


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score of every text."""
    bounded_batches(docs.sparkSession)
    # a fixed size: BUCKETS x (FACTORS + 1) floats
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, own = worker_memory("toxicity", Terms), shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = np.zeros(len(texts))
            for lo, hi in in_portions(map(len, texts), PORTION) if own else ():
                z, _ = logits(own, hi - lo, *terms.of(texts[lo:hi], own["active"]))
                scores[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": scores})

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all ``documents``; labels of every fifth hash value are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
