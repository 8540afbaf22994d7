"""Embedding near-duplicates by an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; the product of
the codebooks is a grid of cells.  Every vector lies in the cell of its nearest
codewords.  As a query it visits cells by the multi-sequence order - ascending sum
of the squared distances of its halves to the cell's codewords - until the sum
exceeds that of its own cell by ``slack``.  The slack is the one at which
``TARGET_RECALL`` of simulated neighbours, at just the threshold's cosine, are
visited from one side or the other.  Whatever is visited is verified by its cosine
in double precision, so no link is below the threshold.

Neighbouring cells are stored in *blocks*; a query goes to a block once.  Blocks
with more than ``BLOCK`` vectors or queries are dealt into parts and chunks, each
pair of which is a group of bounded size.  A group returns sums and the edges of a
spanning forest, never its pairs.  Equal vectors are one vector with a weight.

The codebooks and the slack are fitted on at most ``SAMPLE`` vectors (least hash);
all vectors are indexed and all are queries.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are kept; vectors of different lengths don't
link; repeated rows are vectors of their own; a null vec_id has a null component;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .components import components

THRESHOLD = 0.95
TARGET_RECALL = 0.995
SAMPLE = 10_000
#: Vectors or queries of a group; vectors a cell should hold; codewords of a half at most.
BLOCK, CELL, MOST_WORDS = 2048, 24, 512
_SIMULATED = 2000


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1), 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k-means codewords."""
    k = max(1, min(k, len(x)))
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _distances(x, words).argmin(1)
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def multi_sequence(a: np.ndarray, b: np.ndarray, slack: float) -> Iterator[tuple[int, int, float]]:
    """Cells (i, j) by ascending a[i] + b[j], with what the sum exceeds the least sum by, up to ``slack``."""
    i_order, j_order = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    least = float(a[i_order[0]] + b[j_order[0]])
    heap, pushed = [(0.0, 0, 0)], {(0, 0)}
    while heap:
        over, r, s = heapq.heappop(heap)
        if over > slack:
            return
        yield i_order[r], j_order[s], over
        for r2, s2 in ((r + 1, s), (r, s + 1)):
            if r2 < len(i_order) and s2 < len(j_order) and (r2, s2) not in pushed:
                pushed.add((r2, s2))
                heapq.heappush(heap, (float(a[i_order[r2]] + b[j_order[s2]]) - least, r2, s2))


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, target: float = TARGET_RECALL, seed: int = 11) -> dict:
    """Codebooks and slack for ``n`` vectors, from a sample of unit vectors of one length."""
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    k = int(np.clip(round((n / CELL) ** 0.5), 1, min(MOST_WORDS, max(1, len(sample) // 8))))
    one, two = codebook(sample[:, :half], k, rng), codebook(sample[:, half:], k, rng)
    x = sample[rng.choice(len(sample), min(_SIMULATED, len(sample)), replace=False)]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    y = threshold * x + (1 - threshold**2) ** 0.5 * noise

    def over(q: np.ndarray, t: np.ndarray) -> np.ndarray:
        a, b = _distances(q[:, :half], one), _distances(q[:, half:], two)
        i, j = _distances(t[:, :half], one).argmin(1), _distances(t[:, half:], two).argmin(1)
        rows = np.arange(len(q))
        return a[rows, i] + b[rows, j] - a.min(1) - b.min(1)

    slack = float(np.quantile(np.minimum(over(x, y), over(y, x)), target)) + 1e-9
    return {"one": one, "two": two, "slack": slack, "wide": max(1, min(k, -(-BLOCK // max(1, 2 * (n // (k * k) + 1)))))}


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(column: str = "embedding"):
    """Whether a vector can link at all; null counts as not."""
    c = F.col(column)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(c, lambda v: v != 0), F.lit(False))


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("ok", valid()).withColumn("h", F.when(F.col("ok"), F.xxhash64("embedding"))).withColumn("g", F.when(F.col("ok"), F.hash(F.lit(7), "embedding")))
    sound = rows.where("ok and vec_id is not null")
    # equal vectors: aggregated before they are exchanged
    reps = stored(sound.groupBy("h", "g").agg(F.min(F.struct("vec_id", "embedding")).alias("r"), F.count("*").alias("weight")).select("h", "g", F.col("r.vec_id").alias("id"), F.col("r.embedding").alias("embedding"), "weight"), "reps")
    n = reps.count()
    share = min(1.0, 1.3 * SAMPLE / max(n, 1))
    drawn = reps.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    models: dict[int, dict] = {}
    for size in sorted({len(r["embedding"]) for r in drawn}):
        own = np.array([r["embedding"] for r in drawn if len(r["embedding"]) == size])
        models[size] = fit(_unit(own), max(1, n * len(own) // len(drawn)), threshold, target)
    shared = spark.sparkContext.broadcast(models)  # codebooks: at most MOST_WORDS words for each half

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, weights = batch.column("id").to_pylist(), batch.column("weight").to_pylist()
            blocks, visits, raws = [], [], []
            lists = batch.column("embedding").to_pylist()
            for vec in lists:
                x = np.array(vec)
                raws.append(x.astype("<f8").tobytes())
                unit = x / np.linalg.norm(x)
                model = known.get(len(x))
                if model is None:  # a length that the sample doesn't have: one block
                    blocks.append(len(x) << 40)
                    visits.append([len(x) << 40])
                    continue
                half = len(x) // 2
                a = _distances(unit[None, :half], model["one"])[0]
                b = _distances(unit[None, half:], model["two"])[0]
                name = lambda i, j, w=model["wide"], base=len(x) << 40: base | i << 20 | j // w
                blocks.append(name(int(a.argmin()), int(b.argmin())))
                visits.append(list(dict.fromkeys(name(i, j) for i, j, _ in multi_sequence(a, b, model["slack"]))))
            yield pa.RecordBatch.from_pydict(
                {"id": ids, "weight": pa.array(weights, pa.int64()), "raw": pa.array(raws, pa.binary()), "block": pa.array(blocks, pa.int64()), "visits": pa.array(visits, pa.list_(pa.int64()))}
            )

    placed = stored(reps.select("id", "weight", "embedding").mapInArrow(assign, "id long, weight long, raw binary, block long, visits array<long>"), "placed")
    # vectors and queries of a block: a row for each block, of which there are at most MOST_WORDS squared for each length
    held = placed.groupBy("block").agg(F.count("*").alias("v"))
    asked = placed.select(F.explode("visits").alias("block")).groupBy("block").agg(F.count("*").alias("q"))
    sizes = held.join(asked, "block").select("block", F.ceil(F.col("v") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("q") / BLOCK).cast("int").alias("chunks"))
    sizes = F.broadcast(stored(sizes, "blocks"))
    columns = ("id", "weight", "raw", F.col("block").alias("own"), "visits")
    members = placed.join(sizes, "block").select("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), *columns)
    queries = placed.withColumn("at", F.explode("visits")).join(sizes.withColumnRenamed("block", "at"), "at").select(
        F.col("at").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), *columns
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return _compared(group, threshold)

    found = members.unionByName(queries).groupBy("block", "part", "chunk").applyInPandas(compare, "id long, links long, parent long")
    found = stored(found, "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.where("parent is not null").select(F.col("id").alias("a"), F.col("parent").alias("b")))
    classes = reps.select("h", "g", "id", "weight").join(links, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    classes = classes.select("h", "g", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("vec_id", "h", "g").join(classes, ["h", "g"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _compared(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links that queries (side 1) have with members (side 0) of one group: (id, links, parent in a spanning forest)."""
    y, q = group[group["side"] == 0], group[group["side"] == 1]
    empty = pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "parent": pd.Series(dtype="Int64")})
    if not len(y) or not len(q):
        return empty
    yx, qx = (_unit(np.stack([np.frombuffer(r, "<f8") for r in side["raw"]])) for side in (y, q))
    y_id, q_id = y["id"].to_numpy(), q["id"].to_numpy()
    y_w, q_w = y["weight"].to_numpy(), q["weight"].to_numpy()
    own, q_own = np.unique(q["own"].to_numpy(), return_inverse=True)
    # whether the member as a query comes to the block of the other: then that group counts the link for it
    back = np.zeros((len(y), len(own)), bool)
    for k, v in enumerate(y["visits"]):
        back[k] = np.isin(own, v)
    nodes = np.unique(np.r_[y_id, q_id])
    y_at, q_at = np.searchsorted(nodes, y_id), np.searchsorted(nodes, q_id)
    links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for lo in range(0, len(q), 256):
        at, to = np.nonzero(qx[lo : lo + 256] @ yx.T >= threshold)
        at += lo
        other = q_id[at] != y_id[to]
        at, to = at[other], to[other]
        if not len(at):
            continue
        np.add.at(links, q_at[at], y_w[to])
        alone = ~back[to, q_own[at]]
        np.add.at(links, y_at[to[alone]], q_w[at[alone]])
        u, v = q_at[at], y_at[to]
        while True:  # join the labels of both ends
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                break
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    use = (links > 0) | (label != np.arange(len(nodes)))
    parent = pd.array(np.where(label != np.arange(len(nodes)), nodes[label], -1)[use], "Int64")
    parent[(label == np.arange(len(nodes)))[use]] = pd.NA
    return pd.DataFrame({"id": nodes[use], "links": links[use], "parent": parent}) if use.any() else empty


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more between all ``embeddings``."""
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
