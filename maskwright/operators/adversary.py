"""What can be learned back from noisy vectors: pair discriminators, re-identification, and the least noise that defeats them.

A *discriminator* is a logistic model on a few features of a pair of representations:
whether both come from one vector.  Models for all strengths of noise are fitted
together: every Newton step is one aggregate by strength, whose few sums alone go to
the driver.  Rows with odd ``place`` learn, those with even ``place`` judge.

A *re-identifier* is a linear map from representations back to vectors.  Its sums of
products, as large as the square of the number of components, are added up in Arrow
batches and then by place.

Noise is drawn once for each vector and scaled for every strength, additive or
multiplicative, with one scale for all components or each by its own deviation.

Defined cases: pairs with a null, a zero or a non-finite vector take no part; without
learning pairs a model guesses, so its loss is ln 2; ties in the probability count as
``same``; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from ..storage import stored
from .sampling import numbered, shuffled
from .vectors import dot, gaussian, norm

#: Newton steps, and what keeps them finite on separable pairs.
STEPS, RIDGE = 8, 1e-3
CHANCE_LOSS = math.log(2)
FEATURES = ("cosine", "distance", "length", "one")


def binary_crossentropy(same: Column, p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
    return -F.when(same == 1, F.log(p)).otherwise(F.log(1 - p))


def discriminator_loss(loss: Column) -> Column:
    """No less than guessing: a model that is worse could be turned round."""
    return F.greatest(loss, F.lit(CHANCE_LOSS))


def adversarial_objective(loss: Column) -> Column:
    """How far a loss is from that of guessing, either way."""
    return F.abs(loss - CHANCE_LOSS)


def representations(vectors: DataFrame, seed: int = 0, by_component: bool = False) -> DataFrame:
    """id, place, x, first, second: vectors with two draws of noise each, and a place in a hash order.

    With ``by_component`` a draw is scaled by its component's deviation over all vectors.
    """
    ok = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = vectors.select("id", F.transform("vec", lambda v: v.cast("double")).alias("x")).where(F.col("vec").isNotNull() & ok & F.col("id").isNotNull())
    rows = numbered(rows, shuffled("id", seed), "id", "place")

    def drawn(s: int) -> Column:
        return F.transform("x", lambda _, i: gaussian(i, F.col("id").cast("string"), s))

    rows = rows.select("id", "place", "x", drawn(seed * 10 + 11).alias("first"), drawn(seed * 10 + 13).alias("second"))
    if by_component:
        spread = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.stddev_pop("v").alias("sd"))
        scales = spread.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "sd"))), lambda s: s["sd"]).alias("sd"))  # a row for each component
        rows = rows.join(F.broadcast(scales)).withColumns({c: F.zip_with(c, "sd", lambda z, s: z * s) for c in ("first", "second")}).drop("sd")
    return rows


def pairs(rows: DataFrame) -> DataFrame:
    """place, same, x, a, other, b: each vector's first draw with its own second (1), and with that of the next in order (0)."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    follows = rows.select(F.col("place").alias("next"), F.col("x").alias("other"), F.col("second").alias("b"))
    own = rows.join(F.broadcast(total)).withColumn("next", (F.col("place") + 1) % F.col("total"))
    apart = own.where("next <> place").join(follows, "next").select("place", F.lit(0).alias("same"), "x", F.col("first").alias("a"), "other", "b")
    return rows.select("place", F.lit(1).alias("same"), "x", F.col("first").alias("a"), F.col("x").alias("other"), F.col("second").alias("b")).unionByName(apart)


def noisy(x: str, z: str, scale: Column, multiplicative: bool) -> Column:
    return F.zip_with(x, z, lambda v, n: v * (1 + scale * n) if multiplicative else v + scale * n)


def pair_features(pairs_: DataFrame, scales: list[float], multiplicative: bool = False) -> DataFrame:
    """scale, place, same, f: features of every pair at every strength of noise."""
    rows = pairs_.withColumn("scale", F.explode(F.array(*(F.lit(float(s)) for s in scales))))
    left, right = noisy("x", "a", F.col("scale"), multiplicative), noisy("other", "b", F.col("scale"), multiplicative)

    def of(p: Column) -> Column:
        lengths = bound(F.struct(norm(p["l"]).alias("a"), norm(p["r"]).alias("b"), dot(p["l"], p["r"]).alias("d")), lambda n: F.array(
            F.coalesce(F.try_divide(n["d"], n["a"] * n["b"]), F.lit(0.0)), F.sqrt(F.greatest(n["a"] * n["a"] + n["b"] * n["b"] - 2 * n["d"], F.lit(0.0))) / (1 + n["a"] + n["b"]), F.abs(n["a"] - n["b"]) / (1 + n["a"] + n["b"]), F.lit(1.0)
        ))
        return lengths

    return rows.select("scale", "place", "same", bound(F.struct(left.alias("l"), right.alias("r")), of).alias("f"))


def _logit(weights: Column) -> Column:
    return F.aggregate(F.zip_with("f", weights, lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v)


def _with_weights(features: DataFrame, weights: dict[float, np.ndarray]) -> DataFrame:
    """``features`` with ``p``, the probability of ``same`` by its strength's model."""
    table = F.create_map(*(x for s, w in weights.items() for x in (F.lit(s), F.array(*(F.lit(float(v)) for v in w)))))
    return features.withColumn("p", 1 / (1 + F.exp(-_logit(table[F.col("scale")]))))


def fit_discriminators(features: DataFrame, scales: list[float], steps: int = STEPS) -> dict[float, np.ndarray]:
    """Weights by strength of noise; every step reads ``features`` once, for all strengths."""
    k = len(FEATURES)
    weights = {float(s): np.zeros(k) for s in scales}
    learning = features.where("place % 2 = 1")
    for _ in range(steps):
        rows = _with_weights(learning, weights)
        f = lambda i: F.get("f", F.lit(i))
        sums = [F.sum((F.col("same") - F.col("p")) * f(i)).alias(f"g{i}") for i in range(k)]
        sums += [F.sum(F.col("p") * (1 - F.col("p")) * f(i) * f(j)).alias(f"h{i}{j}") for i in range(k) for j in range(i, k)]
        for r in rows.groupBy("scale").agg(F.count("*").alias("n"), *sums).collect():  # a row for each strength
            w, n = weights[r["scale"]], r["n"]
            slope = np.array([r[f"g{i}"] for i in range(k)]) / n - RIDGE * w
            bend = np.array([[r[f"h{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)]) / n + RIDGE * np.eye(k)
            weights[r["scale"]] = w + np.linalg.solve(bend, slope)
    return weights


def judged(features: DataFrame, weights: dict[float, np.ndarray]) -> DataFrame:
    """scale, n, accuracy, loss, discriminator_loss, objective on the pairs that no model learned from."""
    rows = _with_weights(features.where("place % 2 = 0"), weights)
    right = ((F.col("p") >= 0.5).cast("int") == F.col("same")).cast("double")
    found = rows.groupBy("scale").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(binary_crossentropy(F.col("same"), F.col("p"))).alias("loss"))
    return found.select("scale", "n", "accuracy", "loss", discriminator_loss(F.col("loss")).alias("discriminator_loss"), adversarial_objective(F.col("loss")).alias("objective"))


def discriminate(vectors: DataFrame, scales: list[float], multiplicative: bool = False, by_component: bool = False, seed: int = 0) -> DataFrame:
    """``judged`` discriminators for every strength of noise on ``vectors`` (id, vec)."""
    both = stored(pairs(stored(representations(vectors, seed, by_component), "representations")), "pairs")
    features = stored(pair_features(both, scales, multiplicative), "pair-features")
    return judged(features, fit_discriminators(features, scales))


@dataclass(frozen=True)
class NoiseScale:
    """The least strength at which the discriminator is at chance, what it reached there, and all strengths tried."""

    scale: float | None
    accuracy: float
    tried: list[tuple[float, float]]


def least_noise(vectors: DataFrame, low: float = 0.01, high: float = 10.0, rounds: int = 3, each: int = 8, within: float | None = None, multiplicative: bool = False, by_component: bool = False, seed: int = 0) -> NoiseScale:
    """Search for the least scale that leaves a discriminator guessing.

    Each round judges ``each`` scales between those that enclose the answer, all in
    one set of passes.  At chance is an accuracy no more than ``within`` above a half
    (two deviations of a guess by default).  ``scale`` is None if even ``high`` is told apart.
    """
    both = stored(pairs(stored(representations(vectors, seed, by_component), "representations")), "pairs")
    known: dict[float, float] = {}
    for _ in range(rounds):
        scales = [float(s) for s in np.geomspace(low, high, each) if float(s) not in known]
        if scales:
            features = stored(pair_features(both, scales, multiplicative), "pair-features")
            found = judged(features, fit_discriminators(features, scales)).collect()  # a row for each strength
            if not found:
                return NoiseScale(None, 0.5, [])
            known |= {r["scale"]: r["accuracy"] for r in found}
            allowed = within if within is not None else 1 / math.sqrt(found[0]["n"])
        chance = [s for s in sorted(known) if known[s] <= 0.5 + allowed]
        told = [s for s in sorted(known) if known[s] > 0.5 + allowed]
        if not chance or not told or told[-1] > chance[-1]:
            break
        low, high = told[-1], min(s for s in chance if s > told[-1])
    above = [s for s in chance if not told or s > told[-1]]
    best = min(above) if above else None
    return NoiseScale(best, known[best] if best is not None else max(known.values()), sorted(known.items()))


# --- re-identification -----------------------------------------------------------------------


def reidentify(vectors: DataFrame, scale: float, multiplicative: bool = False, seed: int = 0, ridge: float = 1e-3) -> DataFrame:
    """n, error, cosine: how near a linear map from noisy representations comes to the vectors, on rows that it didn't learn from."""
    rows = representations(vectors, seed)
    rows = stored(rows.select("place", "x", noisy("x", "first", F.lit(float(scale)), multiplicative).alias("r")), "noisy")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                r, x = (np.stack(batch[c]) for c in ("r", "x"))
                r = np.column_stack([r, np.ones(len(r))])
                both = np.concatenate([r.T @ r, r.T @ x], axis=1)
                yield pd.DataFrame({"at": np.arange(both.shape[0]), "line": list(both)})

    # per batch (components + 1) rows; added up before and after the exchange
    learning = rows.where("place % 2 = 1").select("r", "x").mapInPandas(products, "at int, line array<double>")
    size = rows.select(F.size("x").alias("n")).agg(F.max("n")).first()[0] or 0
    width = 2 * size + 1
    sums = learning.groupBy("at").agg(*(F.sum(F.get("line", F.lit(j))).alias(f"c{j}") for j in range(width))).orderBy("at").collect()  # components squared
    back = np.zeros((size + 1, size))
    if sums:
        both = np.array([[r[f"c{j}"] for j in range(width)] for r in sums])
        gram = both[:, : size + 1]
        back = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(size + 1), both[:, size + 1 :])
    shared = rows.sparkSession.sparkContext.broadcast(back)  # components squared

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                r, x = (np.stack(batch[c]) for c in ("r", "x"))
                guess = np.column_stack([r, np.ones(len(r))]) @ shared.value
                lengths = np.linalg.norm(guess, axis=1) * np.linalg.norm(x, axis=1)
                yield pd.DataFrame({"error": ((guess - x) ** 2).mean(1), "cosine": np.divide((guess * x).sum(1), lengths, out=np.zeros(len(x)), where=lengths > 0)})

    found = rows.where("place % 2 = 0").select("r", "x").mapInPandas(judge, "error double, cosine double")
    return found.agg(F.count("*").alias("n"), F.avg("error").alias("error"), F.avg("cosine").alias("cosine"))
