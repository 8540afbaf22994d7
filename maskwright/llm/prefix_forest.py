"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree hashes a vector to a string of ``BITS`` signs of orthogonal random
projections and keeps all strings as one sorted array.  The array is range
partitioned and cut into *blocks* of neighbouring strings; equal strings are told
apart by vec_id, so no string is too frequent for its block.  A query descends to
its place in each array, then ascends all trees together: the level falls from the
longest common prefix until the strings that share ``level`` signs with it come to
``wanted`` candidates over all trees.  That level is a range of each sorted array,
which the query visits block by block, and every vector of the range is compared by
its inner product in double precision.  Nothing cuts a range short.  The blocks that
hold the query's own place come first, and their ``k + 1`` best are the floor that a
vector of the other blocks must reach to be sent on.

``wanted`` is calibrated for each search: at most ``CALIBRATION`` query rows (least
hash) are answered exactly in one pass over all vectors, and the least number is
taken at which ``TARGET_RECALL`` of their neighbours lie in the ranges.  On vectors
without any structure this needs long ranges, on clustered ones short ones.

Inner products are turned into angles by one more component that fills each vector
up to the largest norm of its band; a band holds norms within a factor of 2 (the
last all the rest), so a few long vectors don't spoil the angles of all others.

Counts of short prefixes come from a histogram of at most ``2**MOST_PREFIX`` prefixes
a tree; longer ones are counted within the query's own block, which counts too few
at its ends and so errs towards more candidates.

Of equal vectors the ``k + 1`` least ids are indexed, since no others can be among
the ``k`` nearest; equal query vectors are searched for once.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part; rows with a null vec_id neither; vectors of different
lengths are never compared; repeated rows of one vec_id are one candidate; ties go
to the smaller vec_id; a query vec_id with unlike vectors has a list for each; fewer than ``k`` candidates are all returned; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .multi_index import valid

TREES, BITS = 10, 128
TARGET_RECALL, CALIBRATION = 0.96, 256
#: Strings of a block at least and at most; visits that one task compares with a block; signs of the histogram at most.
BLOCK, MOST_BLOCK, VISITS, MOST_PREFIX = 4096, 65_536, 2048, 18
#: Blocks that the directory should hold at most.
DIRECTORY = 4096
BANDS = 16
INDEX = "side int, tree long, hash binary, id long, dim int, raw binary"


@lru_cache(256)
def planes(dim: int, tree: int) -> np.ndarray:
    """``BITS`` directions for vectors of ``dim`` components and the filling one: orthogonal in runs as long as there are components."""
    rng = np.random.default_rng([dim, tree, 17])
    runs = [np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0].T for _ in range(-(-BITS // (dim + 1)))]
    return np.concatenate(runs)[:BITS]


def strings(x: np.ndarray, filling: np.ndarray, tree: int) -> np.ndarray:
    """Hash strings as rows of bytes."""
    return np.packbits(np.column_stack([x, filling]) @ planes(x.shape[1], tree).T > 0, axis=1)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading signs that rows of bytes share."""
    bits = np.unpackbits(a ^ b, axis=-1)
    return np.where(bits.any(-1), bits.argmax(-1), bits.shape[-1])


def _packed(lists: pa.Array) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Rows of each length: their places, the length, their components."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield at, dim, flat[offsets[at][:, None] + np.arange(dim)]


def _raw(x: np.ndarray) -> list[bytes]:
    """Components as bytes, in single precision where that loses nothing."""
    single = x.astype("<f4")
    exact = (single.astype(np.float64) == x).all(1)
    return [(single[i] if exact[i] else x[i].astype("<f8")).tobytes() for i in range(len(x))]


def _vector(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8" if len(raw) == 8 * dim else "<f4").astype(np.float64)


def _products(y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row, always summed in one order, so that equal vectors tie."""
    return (y * q).sum(1)


def _best(scores: np.ndarray, y: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and products of the ``k`` nearest of ``y``, from ``scores`` that rounding may have moved a little."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least - 1e-9 * max(1.0, float(np.abs(scores).max())))
    exact = _products(y[at], q)
    order = np.lexsort((ids[at], -exact))[:k]
    return ids[at][order], exact[order]


def nearest(vectors: DataFrame, asked: Column, k: int = 20, trees: int = TREES, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` vectors found nearest to each row for which ``asked`` (of vec_id) holds."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(valid() & F.col("vec_id").isNotNull())
    rows = rows.withColumns({"h": F.xxhash64("embedding"), "g": F.hash(F.lit(7), "embedding"), "asks": asked})
    place = W.partitionBy("h", "g").orderBy("vec_id")
    # one row for each vec_id and vector, then the least ids of each vector: both limits apply before the exchange too
    members = rows.groupBy("h", "g", "vec_id").agg(F.first("embedding").alias("embedding")).withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    members = stored(members.select("vec_id", "embedding", norm.alias("norm")), "members")
    queries = rows.where("asks").groupBy("h", "g").agg(F.min("vec_id").alias("query"), F.first("embedding").alias("embedding"))
    queries = stored(queries, "queries")

    most = members.agg(F.max("norm")).first()[0]
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    band = F.least(F.lit(BANDS - 1), F.floor(F.log2(F.lit(most) / F.col("norm"))).cast("int"))
    members = members.withColumn("band", F.greatest(band, F.lit(0)))
    found = members.groupBy(F.size("embedding").alias("dim"), "band").agg(F.count("*").alias("n")).collect()  # lengths and bands
    bands: dict[int, list[int]] = {}
    for r in found:
        bands.setdefault(r["dim"], []).append(r["band"])
    total = sum(r["n"] for r in found)
    width = int(np.clip(np.ceil(np.log2(max(2, total) / 2048)), 4, MOST_PREFIX))
    size = int(np.clip(total * trees // DIRECTORY, BLOCK, MOST_BLOCK))

    def hashed(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for at, dim, x in _packed(batch.column(1)):
                    squared = (x * x).sum(1)
                    if side:  # queries go to every band, as directions
                        own = [(b, x, np.zeros(len(x)), at) for b in bands.get(dim, ())]
                    else:
                        of = batch.column(2).to_numpy()[at]
                        own = [(b, x[of == b], np.sqrt(np.maximum((most / 2.0**b) ** 2 - squared[of == b], 0)), at[of == b]) for b in np.unique(of).tolist()]
                    for b, part, filling, places in own:
                        raw = _raw(part)
                        for t in range(trees):
                            n = len(part)
                            yield pa.RecordBatch.from_pydict(
                                {
                                    "side": pa.array(np.full(n, side, np.int32)),
                                    "tree": pa.array(np.full(n, dim << 16 | b << 8 | t, np.int64)),
                                    "hash": pa.array([s.tobytes() for s in strings(part, filling, t)], pa.binary()),
                                    "id": pa.array(ids[places]),
                                    "dim": pa.array(np.full(n, dim, np.int32)),
                                    "raw": pa.array(raw, pa.binary()),
                                }
                            )

        return run

    index = members.select("vec_id", "embedding", "band").mapInArrow(hashed(0), INDEX)
    places = queries.select("query", "embedding").mapInArrow(hashed(1), INDEX)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * trees // (4 * size))
    arrays = stored(index.unionByName(places), "strings").repartitionByRange(tasks, "tree", "hash", "side", "id").sortWithinPartitions("tree", "hash", "side", "id")

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _task_number() << 32
        for table in _runs(batches, size):
            yield _profiled(table, number)
            number += 1

    arrays = stored(arrays.mapInArrow(blocked, INDEX + ", block long, shared array<int>"), "arrays", 8 << 20)
    heads = arrays.groupBy("tree", "block").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    directory = _directory(heads.orderBy("tree", "low", "block").collect())  # at most about DIRECTORY blocks and one for each task and tree
    prefix = F.conv(F.hex(F.substring("hash", 1, 4)), 16, 10).cast("long")
    short = arrays.where("side = 0").groupBy("tree", F.shiftright(prefix, 32 - width).alias("p")).agg(F.count("*").alias("n")).collect()  # 2**width at most for each tree
    counts = _short_counts(short, width)
    shared = spark.sparkContext.broadcast((directory, counts))

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each query's place says of its tree: how many strings share so many signs."""
        _, known = shared.value
        for batch in batches:
            out = []
            for tree, string, own in zip(batch.column("tree").to_pylist(), batch.column("hash").to_pylist(), batch.column("shared").to_pylist(), strict=True):
                line = np.array(own, np.int64)
                head = int.from_bytes(string[:4], "big")
                for level in range(width + 1):
                    line[level] = known[tree][level][head >> (32 - level)] if tree in known else 0
                line[: width + 1] = np.maximum(line[: width + 1], line[width + 1])
                out.append(line)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "line": pa.array(out, pa.list_(pa.int64()))})

    asked_at = arrays.where("side = 1")
    lines = asked_at.select("id", "tree", "hash", "shared").mapInArrow(levels, "id long, line array<long>")
    # a query has a line for each tree and band: bounded
    together = F.aggregate("lines", F.array_repeat(F.lit(0).cast("long"), BITS + 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    sums = stored(lines.groupBy("id").agg(F.collect_list("line").alias("lines")).select("id", together.alias("line")), "sums")
    wanted = _calibrated(rows, members, queries, sums, most, bands, trees, k, target)
    reached = F.aggregate("line", F.lit(-1), lambda n, x: n + F.when(x >= wanted, 1).otherwise(0))
    chosen = sums.select("id", F.greatest(reached, F.lit(0)).alias("level"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = shared.value
        for batch in batches:
            rows_, blocks, lows, highs = [], [], [], []
            own = (batch.column(c).to_pylist() for c in ("tree", "hash", "level"))
            for i, (tree, string, level) in enumerate(zip(*own, strict=True)):
                low, high = _range(string, level)
                names, firsts, lasts = known[tree]
                for b in names[int(np.searchsorted(lasts, low)) : int(np.searchsorted(firsts, high, side="right"))].tolist():
                    rows_.append(i)
                    blocks.append(b)
                    lows.append(low)
                    highs.append(high)
            taken = pa.array(rows_, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array(blocks, pa.int64()), "home": batch.column("block").take(taken), "id": batch.column("id").take(taken), "dim": batch.column("dim").take(taken), "raw": batch.column("raw").take(taken), "low": pa.array(lows, pa.binary()), "high": pa.array(highs, pa.binary())}
            )

    visited = asked_at.join(chosen, "id").select("id", "tree", "hash", "dim", "raw", "level", "block")
    visited = stored(visited.mapInArrow(visits, "block long, home long, id long, dim int, raw binary, low binary, high binary"), "visits")

    def compared(some: DataFrame, name: str) -> DataFrame:
        """query, vec_id, score of what visits (with ``floor``) find in their blocks."""
        chunks = F.broadcast(stored(some.groupBy("block").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("chunks")), "chunks"))  # a row for each block
        none = F.lit(None)
        held = arrays.where("side = 0").join(chunks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "id", "dim", "raw", F.col("hash").alias("low"), none.cast("binary").alias("high"), none.cast("double").alias("floor"))
        come = some.join(chunks, "block").select("block", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "id", "dim", "raw", "low", "high", "floor")
        return stored(held.unionByName(come).groupBy("block", "chunk").applyInPandas(lambda group: _compared(group, k + 1), "query long, vec_id long, score double"), name)

    def ranked(found_: DataFrame) -> DataFrame:
        best = found_.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)

    first = compared(visited.where("block = home").withColumn("floor", F.lit(float("-inf"))), "first")
    floors = ranked(first).where(F.col("n") == k + 1).select(F.col("query").alias("id"), F.col("score").alias("floor"))
    others = visited.where("block <> home").join(stored(floors, "floors"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    near = ranked(first.unionByName(compared(others, "rest")))
    lists = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))  # k + 1 at most
    lists = stored(queries.select("h", "g", "query").join(lists, "query"), "lists")
    out = rows.where("asks").select("vec_id", "h", "g").distinct().join(lists.drop("query"), ["h", "g"])
    listed = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(listed).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Neighbours of one tree, ``size`` at most."""
    held: list[pa.RecordBatch] = []
    n, tree = 0, None
    for batch in batches:
        of = batch.column("tree").to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            while a < b:
                if held and (of[a] != tree or n >= size):
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                tree, step = of[a], min(b - a, size - n)
                held.append(batch.slice(a, step))
                n, a = n + step, a + step
    if held:
        yield pa.Table.from_batches(held)


def _matrix(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, BITS // 8)


def _profiled(table: pa.Table, number: int) -> pa.RecordBatch:
    """A block with its number and, for queries, how many of its vectors share at least 0, 1, .. ``BITS`` signs with them."""
    side = table.column("side").to_numpy()
    hashes = _matrix(table.column("hash").to_pylist())
    beside = common_prefix(hashes[:-1], hashes[1:])
    lines: list = [None] * len(side)
    for at in np.flatnonzero(side == 1).tolist():
        level = np.concatenate([np.minimum.accumulate(beside[:at][::-1])[::-1], [BITS], np.minimum.accumulate(beside[at:])])
        lines[at] = np.bincount(level[side == 0], minlength=BITS + 1)[::-1].cumsum()[::-1].astype(np.int32)
    columns = {name: table.column(name).combine_chunks() for name in table.column_names}
    return pa.RecordBatch.from_pydict(columns | {"block": pa.array(np.full(len(side), number, np.int64)), "shared": pa.array(lines, pa.list_(pa.int32()))})


def _directory(heads: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each tree its blocks with their first and last strings."""
    out: dict[int, list] = {}
    for r in heads:
        out.setdefault(r["tree"], []).append((r["block"], bytes(r["low"]), bytes(r["high"])))
    kind = f"S{BITS // 8}"
    return {t: (np.array([b for b, _, _ in rows], np.int64), np.array([low for _, low, _ in rows], kind), np.array([high for _, _, high in rows], kind)) for t, rows in out.items()}


def _short_counts(rows: list, width: int) -> dict[int, list[np.ndarray]]:
    """For each tree, by level from 0 to ``width``, the vectors of each prefix."""
    last: dict[int, np.ndarray] = {}
    for r in rows:
        last.setdefault(r["tree"], np.zeros(1 << width, np.int64))[r["p"]] = r["n"]
    out = {}
    for tree, counts in last.items():
        levels = [counts]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).sum(1))
        out[tree] = levels[::-1]
    return out


def _range(string: bytes, level: int) -> tuple[bytes, bytes]:
    """The first and last string that share ``level`` signs with ``string``."""
    rest = (1 << (BITS - level)) - 1
    value = int.from_bytes(string, "big")
    return (value & ~rest).to_bytes(BITS // 8, "big"), (value | rest).to_bytes(BITS // 8, "big")


def _calibrated(rows: DataFrame, members: DataFrame, queries: DataFrame, sums: DataFrame, most: float, bands: dict[int, list[int]], trees: int, k: int, target: float) -> int:
    """Candidates over all trees at which ``target`` of the neighbours of the calibration queries are met."""
    spark = members.sparkSession
    picked = F.broadcast(rows.where("asks").select("vec_id", "h", "g").orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION))
    drawn = queries.join(picked, ["h", "g"]).groupBy("query").agg(F.first("embedding").alias("embedding"), F.count("*").alias("weight")).collect()
    weights = {r["query"]: r["weight"] for r in drawn}
    asked = spark.sparkContext.broadcast([(r["query"], np.array(r["embedding"])) for r in drawn])  # CALIBRATION vectors at most

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest of this task's vectors for each calibration query, sent once at its end."""
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids, of = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for at, dim, x in _packed(batch.column(1)):
                own = [(query, q) for query, q in asked.value if len(q) == dim]
                if not own:
                    continue
                products = np.stack([q for _, q in own]) @ x.T
                for (query, q), line in zip(own, products, strict=True):
                    if query in held:
                        least = held[query][1][-1] if len(held[query][1]) > k else -np.inf
                        new = np.flatnonzero(line >= least - 1e-9 * max(1.0, abs(least))) if np.isfinite(least) else np.arange(len(line))
                    else:
                        new = np.arange(len(line))
                    if not len(new):
                        continue
                    near = [ids[at[new]], _products(x[new], q), of[at[new]], x[new]]
                    if query in held:
                        near = [np.concatenate(pair) for pair in zip(held[query], near, strict=True)]
                    order = np.lexsort((near[0], -near[1]))[: k + 1]
                    held[query] = tuple(c[order] for c in near)
        for query, (ids, scores, of, x) in held.items():
            yield pa.RecordBatch.from_pydict({"query": pa.array(np.full(len(ids), query, np.int64)), "vec_id": pa.array(ids), "score": pa.array(scores), "embedding": pa.array(list(x), pa.list_(pa.float64())), "band": pa.array(of)})

    best = members.select("vec_id", "embedding", "band").mapInArrow(exact, "query long, vec_id long, score double, embedding array<double>, band int")
    best = best.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where((F.col("n") <= k + 1) & (F.col("query") != F.col("vec_id")))
    truth = best.collect()  # at most CALIBRATION times k + 1 vectors
    lines = {r["id"]: np.array(r["line"]) for r in sums.where(F.col("id").isin(list(weights))).collect()}
    vectors = dict(asked.value)
    met: dict[int, list[int]] = {}
    for r in truth:
        q, y = vectors[r["query"]], np.array(r["embedding"])
        filling = np.sqrt(max((most / 2.0 ** r["band"]) ** 2 - float(y @ y), 0.0))
        ends, fillings = np.stack([q, y]), np.array([0.0, filling])
        level = max(int(common_prefix(*strings(ends, fillings, t))) for t in range(trees))
        met.setdefault(r["query"], []).append(level)
    if not met:
        return 1
    total = max(int(line[0]) for line in lines.values())
    for wanted in np.unique(np.geomspace(max(1, k), max(k, total), 60).astype(np.int64)).tolist():
        hits = [np.mean([level >= max(int((lines[q] >= wanted).sum()) - 1, 0) for level in own]) for q, own in met.items()]
        if np.average(hits, weights=[weights[q] for q in met]) >= target:
            return wanted
    return total


def _compared(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of a block's vectors (side 0) for each visit (side 1), within the visit's range of strings."""
    y, q = group[group["side"] == 0], group[group["side"] == 1]
    if not len(y) or not len(q):
        return pd.DataFrame({"query": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    dim, kind = int(y["dim"].iloc[0]), f"S{BITS // 8}"
    y_hash = np.array(y["low"].tolist(), kind)
    order = np.argsort(y_hash, kind="stable")
    y_hash, ids = y_hash[order], y["id"].to_numpy()[order]
    raws = y["raw"].tolist()
    yx = np.stack([_vector(raws[i], dim) for i in order.tolist()])
    qx = np.stack([_vector(r, dim) for r in q["raw"]])
    lows = np.searchsorted(y_hash, np.array(q["low"].tolist(), kind))
    highs = np.searchsorted(y_hash, np.array(q["high"].tolist(), kind), side="right")
    names, floors = q["id"].to_numpy(), q["floor"].to_numpy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(q), 256):
        products = qx[start : start + 256] @ yx.T
        for i in range(start, min(start + 256, len(q))):
            a, b = int(lows[i]), int(highs[i])
            line = products[i - start, a:b]
            at = np.flatnonzero(line >= floors[i] - 1e-9 * max(1.0, abs(floors[i]))) if np.isfinite(floors[i]) else np.arange(b - a)
            if len(at):
                near, scores = _best(line[at], yx[a:b][at], ids[a:b][at], qx[i], k)
                found.append((np.full(len(near), names[i]), near, scores))
    if not found:
        return _compared(group.iloc[:0], k)
    query, vec_id, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pd.DataFrame({"query": query, "vec_id": vec_id, "score": score})


def op13_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all ``embeddings`` for every row whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
