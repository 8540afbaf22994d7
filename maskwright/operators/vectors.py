"""Vector operators: normalising, cosine and L2 neighbours, ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bound
from ..storage import ship, stored

#: Queries of one set that is broadcast, about, and pairs above which neighbours are found block by block in numpy.
BROADCAST_VECTORS, NATIVE_PAIRS = 50_000, 20_000_000
#: Queries and vectors of one product, and how far products may be from sums in order.
BLOCK, SLACK = 1024, 1e-12
#: Bytes of similarities that a task of ``cosine_ranks`` holds at once, or those of one query, and queries of a task, about.
HELD_BYTES, QUERIES_OF_TASK = 128 << 20, 1024


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: str | Column) -> Column:
    """Unit length; null for the zero vector."""
    c = F.col(a) if isinstance(a, str) else a
    with_norm = bound(c, lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return bound(with_norm, lambda p: F.when(p["n"] > 0, F.transform(p["v"], lambda x: x.cast("double") / p["n"])))


def checked_matrix(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """(word, vec) of a vocabulary, unit length; a word without vector or with the zero vector is an error."""
    both = words.join(vectors, "word", "left")
    ok = F.col("vec").isNotNull() & (norm("vec") > 0)
    return both.select("word", F.when(ok, normalised("vec")).otherwise(F.raise_error(F.concat(F.lit("no vector for "), "word"))).alias("vec"))


def similarities(queries: DataFrame, vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """(query, id, similarity) of every query with every vector; for L2 the distance.

    Queries are a stated set that is broadcast against all vectors.
    """
    q = queries.select(F.col("id").alias("query"), normalised("vec").alias("q"))
    v = vectors.select("id", normalised("vec").alias("v"))
    measure = dot("q", "v") if metric == "cosine" else F.sqrt(F.aggregate(F.zip_with("q", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))
    return v.join(F.broadcast(q)).select("query", "id", measure.alias("similarity"))


def top_neighbours(queries: DataFrame, vectors: DataFrame, n: int, metric: str = "cosine", include_self: bool = True) -> DataFrame:
    """(query, rank, id, similarity): the ``n`` nearest of each query, ties by id.  ``n`` may exceed the number of vectors.

    Few queries are compared in the JVM; many go through block products in numpy,
    where each block of vectors keeps its best ``n`` of each query before anything
    is exchanged.
    """
    count = queries.count()
    if count * vectors.count() <= NATIVE_PAIRS:
        found = similarities(queries, vectors, metric)
    else:
        # sets of queries of bounded size, by hash; each is compared with all vectors
        sets = -(-count // BROADCAST_VECTORS)
        found = None
        for k in range(sets):
            own = queries.where(F.pmod(F.xxhash64("id"), F.lit(sets)) == k) if sets > 1 else queries
            some = _by_blocks(own, vectors, n + (not include_self), metric)
            found = some if found is None else found.unionByName(some)
    if not include_self:
        found = found.where("query <> id")
    order = F.col("similarity").desc() if metric == "cosine" else F.col("similarity").asc()
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(order, "id")))
    return ranked.where(F.col("rank") <= n).select("query", "rank", "id", "similarity")


def packed(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """ids and unit vectors of a set of bounded size, as one array; zero vectors go."""
    rows = vectors.select("id", normalised("vec").alias("v")).where("v is not null").toArrow()
    v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return rows.column("id").to_numpy(), v.reshape(rows.num_rows, -1)


def in_order(a: np.ndarray, b: np.ndarray, metric: str = "cosine") -> np.ndarray:
    """Cosine or distance of unit vectors that lie in columns, added up component by component as ``dot`` does: equal vectors get equal values wherever they lie."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total = total + (x * y if metric == "cosine" else (x - y) * (x - y))
    return total if metric == "cosine" else np.sqrt(total)


class _Best:
    """The ``n`` nearest of each query so far, with all ties of the last."""

    def __init__(self, q: np.ndarray, n: int, metric: str):
        self.q, self.n, self.metric = q, n, metric
        self.least = np.full(len(q), -np.inf)  # below this a product is of no use
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.size = 0

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        s = self.q @ v.T
        if np.isneginf(self.least[:1]).any() and s.shape[1] > self.n:
            self.least = np.partition(s, -self.n, axis=1)[:, -self.n] - SLACK
        i, j = np.nonzero(s >= self.least[:, None])
        self.found.append((i, ids[j], in_order(self.q[i].T, v[j].T, self.metric)))
        self.size += len(i)
        if self.size > 8 * self.n * len(self.q):
            self.cut()

    def cut(self) -> None:
        i, ids, s = (np.concatenate(x) for x in zip(*self.found, strict=True))
        near = s if self.metric == "cosine" else -s
        order = np.lexsort((-near, i))
        i, ids, s, near = i[order], ids[order], s[order], near[order]
        first = np.searchsorted(i, np.arange(len(self.q)))
        sizes = np.diff(np.append(first, len(i)))
        full = np.flatnonzero(sizes >= self.n)
        edge = np.full(len(self.q), -np.inf)
        edge[full] = near[first[full] + self.n - 1]
        self.least = np.maximum(self.least, (edge if self.metric == "cosine" else 1 - edge * edge / 2) - SLACK)
        here = near >= edge[i]
        self.found = [(i[here], ids[here], s[here])]
        self.size = int(here.sum())


def _by_blocks(queries: DataFrame, vectors: DataFrame, n: int, metric: str) -> DataFrame:
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(packed(queries))  # at most BROADCAST_VECTORS

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        held = [_Best(q[lo : lo + BLOCK], n, metric) for lo in range(0, len(q), BLOCK)]
        for batch in batches:
            own = batch.column("id").to_numpy()
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            for lo in range(0, len(own), BLOCK):
                for some in held:
                    some.add(own[lo : lo + BLOCK], v[lo : lo + BLOCK])
        for k, some in enumerate(held):
            some.cut()
            i, near, s = some.found[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[k * BLOCK + i], pa.int64()), pa.array(near, pa.int64()), pa.array(s)], names=["query", "id", "similarity"])

    ship(spark)
    # few files of vectors are much work, so they are dealt to all cores
    dealt = vectors.select(F.col("id").cast("long").alias("id"), normalised("vec").alias("v")).where("v is not null").repartition(2 * spark.sparkContext.defaultParallelism, "id")
    return dealt.mapInArrow(best, "query long, id long, similarity double")


def ranks(found: DataFrame, metric: str = "cosine") -> DataFrame:
    """``found`` with ``rank``: one more than the number of strictly closer vectors."""
    order = F.col("similarity").desc() if metric == "cosine" else F.col("similarity").asc()
    return found.withColumn("rank", F.rank().over(W.partitionBy("query").orderBy(order)))


def _with_gaps(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, which of them have a vector, and those vectors in columns."""
    v = rows.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    has = np.diff(v.offsets.to_numpy()) > 0
    n, flat = int(has.sum()), v.flatten().to_numpy(zero_copy_only=False)
    return rows.column("id").to_numpy(), has, flat.reshape(n, len(flat) // max(n, 1)).T


def cosine_ranks(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, id, rank) of every query with every vector, as ``ranks`` of ``similarities``.

    Its rows grow as queries times vectors, but no pair is exchanged or stored: unit vectors are written once, and a task
    with some of the queries reads them block by block.  It holds the 8 bytes of each pair of one set of queries,
    ``HELD_BYTES``, or one query, at a time.
    """
    spark = queries.sparkSession
    unit = F.coalesce(normalised("vec"), F.array().cast("array<double>"))
    kept = stored(vectors.select(F.col("id").cast("long").alias("id"), unit.alias("v")), "vectors")
    files, n = tuple(sorted(kept.inputFiles())), kept.count()
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-queries.count() // QUERIES_OF_TASK))
    ship(spark)
    dealt = queries.select(F.col("id").cast("long").alias("id"), unit.alias("v")).repartition(tasks, "id")
    return dealt.mapInArrow(lambda batches: _ranked(batches, files, n), "query long, id long, rank int")


def _ranked(batches: Iterator[pa.RecordBatch], files: tuple[str, ...], n: int) -> Iterator[pa.RecordBatch]:
    """Ranks of all vectors in ``files``, ``n`` of them, for each query; queries of one id are ranked as one."""
    rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if rows is None or not rows.num_rows or not n:
        return
    rows = rows.sort_by("id")
    asked, known, q = _with_gaps(rows)
    place = np.cumsum(known) - 1
    heads = np.append(np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]), len(asked))
    start = 0
    while start < len(heads) - 1:
        end = start + 1
        while end < len(heads) - 1 and (heads[end + 1] - heads[start]) * n * 8 <= HELD_BYTES:
            end += 1
        some = np.arange(heads[start], heads[end])
        ids, near = np.empty(n, np.int64), np.full((len(some), n), -np.inf)  # what has no similarity comes last
        has_q, at = np.flatnonzero(known[some]), 0
        for block in _blocks(files):
            own, has, v = _with_gaps(block)
            ids[at : at + len(own)] = own
            to = at + np.flatnonzero(has)
            for lo in range(0, len(has_q) if len(to) else 0, 64):
                part = has_q[lo : lo + 64]
                s = in_order(q[:, place[some[part]], None], v[:, None, :])
                near[part[:, None], to] = np.where(np.isnan(s), np.inf, s)
            at += len(own)
        for a, b in zip(heads[start:end] - heads[start], heads[start + 1 : end + 1] - heads[start], strict=True):
            yield from _by_rank(int(asked[some[a]]), np.tile(ids, b - a), near[a:b].ravel())
        start = end


def _blocks(files: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for file in files:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(batch_size=BLOCK, columns=["id", "v"])


def _by_rank(query: int, ids: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(-near)
    ids, near = ids[order], near[order]
    first = np.r_[True, near[1:] != near[:-1]]
    rank = np.maximum.accumulate(np.where(first, np.arange(1, len(near) + 1), 0)).astype(np.int32)
    for lo in range(0, len(ids), 1 << 16):
        own = ids[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), query, np.int64)), pa.array(own), pa.array(rank[lo : lo + len(own)])], names=["query", "id", "rank"])


def closest_other(found: DataFrame) -> DataFrame:
    """Second hit of each query; the first is the query itself."""
    return found.where("rank = 2")


def noise_report(found: DataFrame, ranks_up_to: tuple[int, ...] = (1, 3, 5, 10), at_least: tuple[float, ...] = (0.3, 0.4)) -> DataFrame:
    """One row: mean and deviation of similarity, shares of ranks and of similarities."""
    s = F.col("similarity")
    return found.agg(
        F.count("*").alias("n"),
        F.avg(s).alias("mean_similarity"),
        F.stddev_pop(s).alias("sd_similarity"),
        *(F.avg((F.col("rank") <= k).cast("double")).alias(f"rank_le_{k}") for k in ranks_up_to),
        *(F.avg((s >= t).cast("double")).alias(f"sim_ge_{int(t * 100)}") for t in at_least),
    )


def _uniform(i: Column, key: Column, seed: int) -> Column:
    """In [0, 1), by place, key and seed: 32 bits of an md5, which SQL can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key, i.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _own_key(a: str | Column, key: Column | None) -> Column:
    """What tells rows apart: ``key``, or the vector itself."""
    return F.xxhash64(F.col(a) if isinstance(a, str) else a).cast("string") if key is None else key.cast("string")


def gaussian(i: Column, key: Column, seed: int) -> Column:
    """A draw of the standard normal distribution."""
    return F.sqrt(-2 * F.log(1 - _uniform(i, key, seed))) * F.cos(2 * np.pi * _uniform(i, key, seed + 1))


def gaussian_noise(a: str, scale: float, seed: int, loc: float = 0.0, clip: float | None = None, key: Column | None = None) -> Column:
    """A vector with noise on every component; noise differs by component through its place, and by row through ``key``."""

    def one(x: Column, i: Column, k: Column) -> Column:
        noise = loc + scale * gaussian(i, k, seed)
        if clip is not None:
            noise = F.greatest(F.least(noise, F.lit(clip)), F.lit(-clip))
        return x.cast("double") + noise

    return bound(_own_key(a, key), lambda k: F.transform(a, lambda x, i: one(x, i, k)))


def multiplied_noise(a: str, scale: float, seed: int, key: Column | None = None) -> Column:
    """A vector with every component times a draw around 1."""
    return bound(_own_key(a, key), lambda k: F.transform(a, lambda x, i: x.cast("double") * (1 + scale * gaussian(i, k, seed))))


def dropout(a: str, probability: float, seed: int, key: Column | None = None) -> Column:
    """A vector with components set to 0 at the given rate."""
    return bound(_own_key(a, key), lambda k: F.transform(a, lambda x, i: F.when(_uniform(i, k, seed) < probability, 0.0).otherwise(x.cast("double"))))


def hashed_embedding(word: str) -> list[float]:
    """Five components of 0.5 or -0.5 from the word alone: decimal digits of its SHA-256, from the second on."""
    digits = str(int(hashlib.sha256(word.encode()).hexdigest(), 16))[1:6]
    return [-0.5 if int(d) < 5 else 0.5 for d in digits]


def with_test_vectors(words: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with ``vec``, the test embedding of each; 256-bit integers are beyond Spark's own functions."""

    @F.pandas_udf("array<double>")
    def embedded(values: pd.Series) -> pd.Series:
        return values.map(hashed_embedding, na_action="ignore")

    return words.withColumn("vec", embedded(word))
