"""Packing of documents into sequences by a configuration linear program.

1. Each document becomes pieces of at most ``capacity`` tokens; only longer
   documents are cut.  Pieces are then told apart by their length alone.
2. The histogram of lengths (at most ``capacity`` numbers, however large the
   corpus) goes to the driver.  The configuration LP - as few sequences as cover
   every length's count - is approached by multiplicative weights: each length has
   a price that falls as it gets covered, and a bounded knapsack dynamic program
   over ``PRICED`` of the lengths (those that lag most, and drawn ones) finds the
   configuration to use next.
3. Steps are a share of demand in whole uses and never go beyond what is left of a
   length, so nothing is lost by rounding.  They end when no configuration of the
   pieces left fills a sequence to ``FILLED``; these are packed by best fit over
   lengths, largest first.  Small tables may lack short pieces then; the last
   configurations are given up to best fit where that saves more than ``SAVED`` of
   all sequences, which large tables don't come near.
4. The plan says, for the r-th piece of a length, its sequence and its offset.
   Ranks come from counts for each (bucket, length), so no length, however
   frequent, is numbered in one task.

Defined cases: null text is an empty document (one piece, the end id); null
doc_id and repeated ids are pieces like others; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored, texts_of
from .tokens import END_ID, encoder_of, tokenizer_path

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: How fast prices fall, how much more a token of a long piece is worth, the share of a length's demand that one step may cover,
#: and lengths that are priced in a round.
RATE, LONG, STEP, PRICED = 0.5, 0.05, 0.5, 128
#: Shares of the configurations, by first use, that may be kept, and what giving up more of them must save: a share of the sequences.
KEPT, SAVED = (1.0, 0.98, 0.9, 0.75, 0.5, 0.25, 0.0), 1e-4
#: Configurations that fill less of a sequence are not used but left to best fit.
FILLED = 0.999


def knapsack(prices: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length goes into the configuration of highest price (index: length), each at most ``limits`` times.

    Dynamic program over capacities; numbers of a length are made of powers of two.
    Ties go to the length of highest price for its size, then to the longest.
    """
    n = capacity
    best = np.zeros(n + 1)
    parts: list[tuple[int, int, np.ndarray]] = []
    lengths = np.flatnonzero((prices[1:] > 0) & (limits[1:] > 0)) + 1
    for length in lengths[np.lexsort((-lengths, -prices[lengths] / lengths))].tolist():
        most, size = min(int(limits[length]), n // length), 1
        while most:
            size = min(size, most)
            totals = best[: n + 1 - size * length] + size * prices[length]
            more = totals > best[size * length :]
            np.maximum(best[size * length :], totals, out=best[size * length :])
            parts.append((length, size, more))
            most -= size
            size *= 2
    made, room = np.zeros(n + 1, np.int64), n
    for length, size, more in reversed(parts):
        if room >= size * length and more[room - size * length]:
            made[length] += size
            room -= size * length
    return made


def fullest(limits: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length goes into a configuration that fills most, each at most ``limits`` times.

    Subset sums as the bits of one integer; numbers of a length are made of powers of two, longest lengths first.
    """
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in (np.flatnonzero(limits[1:] > 0)[::-1] + 1).tolist():
        most, size = min(int(limits[length]), capacity // length), 1
        while most:
            size = min(size, most)
            steps.append((length, size, reach))
            reach |= (reach << (size * length)) & mask
            most -= size
            size *= 2
        if reach >> capacity:
            break
    made, room = np.zeros(capacity + 1, np.int64), reach.bit_length() - 1
    for length, size, before in reversed(steps):
        if not before >> room & 1:  # not reached without these
            made[length] += size
            room -= size * length
    return made


def solve(counts: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) -> list[tuple[dict[int, int], int]]:
    """Configurations {length: how often} with their number of uses; all pieces exactly once.

    ``counts[l]`` is the number of pieces of length l (0..capacity).  At most ``rounds``
    rounds, if given; the rest is packed by best fit.
    """
    return solved(counts, capacity, rounds)["plan"]


def solved(counts: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) -> dict:
    """The ``plan`` of ``solve`` and how good it is.

    ``bound``: sequences that any packing needs, by tokens; ``sequences``; ``gap`` between them;
    ``by_configurations`` and ``by_best_fit``: sequences by where they come from.
    """
    uses, left = configurations(counts, capacity, rounds)
    plans = []
    for share in KEPT:
        kept, rest = uses[: round(share * len(uses))], left.copy()
        for contents, times in uses[len(kept) :]:
            for length, each in contents.items():
                rest[length] += each * times
        plans.append((kept, best_fit(rest, capacity)))
    made = lambda plan: sum(times for _, times in plan)
    needed = [made(kept) + made(rest) for kept, rest in plans]
    # the first that is nearly as good as the best, so that a few sequences in a large corpus give up no configuration
    n, (kept, rest) = next(both for both in zip(needed, plans, strict=True) if both[0] <= (1 + SAVED) * min(needed))
    bound = -(-int(np.asarray(counts, np.int64) @ np.arange(capacity + 1)) // capacity)
    return {"plan": kept + rest, "bound": bound, "sequences": n, "gap": n - bound, "by_configurations": made(kept), "by_best_fit": made(rest)}


def configurations(counts: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """The configurations of ``solve`` before best fit, by first use, and the pieces left of each length."""
    left = np.array(counts, np.int64)
    uses: dict[bytes, int] = {}
    sizes = np.arange(capacity + 1)

    def use(made: np.ndarray, times: int) -> None:
        np.subtract(left, times * made, out=left)
        uses[made.tobytes()] = uses.get(made.tobytes(), 0) + times

    if left[capacity]:
        use((sizes == capacity).astype(np.int64), int(left[capacity]))
    demand = np.maximum(left, 1)
    drawn = np.random.default_rng(0)
    done = 0
    while (rounds is None or done < rounds) and (open_ := np.flatnonzero(left[1:]) + 1).size:
        done += 1
        covered = 1 - left[open_] / demand[open_]
        # a length's price: its size, more for long ones, which fewer others fit, and raised while it lags behind the others
        priced = np.zeros(capacity + 1)
        priced[open_] = open_ * (1 + LONG * open_ / capacity) * np.exp(RATE * (covered.min() - covered))
        some = open_
        if len(open_) > PRICED:
            by_lag = open_[np.lexsort((drawn.random(len(open_)), covered))]
            some = np.concatenate([by_lag[: PRICED // 2], drawn.choice(by_lag[PRICED // 2 :], PRICED // 2, replace=False)])
        prices = np.zeros(capacity + 1)
        prices[some] = priced[some]
        made = knapsack(prices, left, capacity)
        if int(made @ sizes) < FILLED * capacity:  # is there any that fills a sequence?
            made = fullest(left, capacity)
            if int(made @ sizes) < FILLED * capacity:
                break
        inside = made > 0
        share = int(STEP * (demand[inside] / made[inside]).min())
        use(made, min(max(1, share), int((left[inside] // made[inside]).min())))
    plan = []
    for key, times in uses.items():
        made = np.frombuffer(key, np.int64)
        plan.append(({int(x): int(made[x]) for x in np.flatnonzero(made)}, times))
    return plan, left


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, largest first, over groups of like sequences rather than single ones."""
    groups: dict[int, list[list]] = {}  # room -> [[contents, number], ...]
    for length in range(capacity, 0, -1):
        n = int(counts[length])
        for room in sorted(r for r in groups if r >= length) if n else ():
            for group in list(groups[room]):
                if not n:
                    break
                fits = room // length
                whole = min(group[1], n // fits)
                moves = [(fits, whole)] + ([(n - whole * fits, 1)] if whole < group[1] and n - whole * fits else [])
                for each, number in moves:
                    if each and number:
                        contents = dict(group[0])
                        contents[length] = contents.get(length, 0) + each
                        groups.setdefault(room - each * length, []).append([contents, number])
                        group[1] -= number
                        n -= each * number
            groups[room] = [g for g in groups[room] if g[1]]
        if n:
            fits = capacity // length
            if n // fits:
                groups.setdefault(capacity - fits * length, []).append([{length: fits}, n // fits])
            if n % fits:
                groups.setdefault(capacity - (n % fits) * length, []).append([{length: n % fits}, 1])
    return [(contents, number) for members in groups.values() for contents, number in members]


def placements(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan by length: from rank ``lo`` on, ``each`` pieces go into every sequence from ``first`` on, the first of them at ``at``."""
    rows, ranks, first = [], {}, 0
    for contents, times in plan:
        at = 0
        for length in sorted(contents, reverse=True):
            each = contents[length]
            lo = ranks.get(length, 0)
            rows.append((length, lo, each, first, at))
            ranks[length] = lo + each * times
            at += each * length
        first += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "lo": table[:, 1], "each": table[:, 2], "first": table[:, 3], "at": table[:, 4], "n": np.int64(first)}


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    bounded_batches(docs.sparkSession)
    tokenizer = tokenizer or tokenizer_path(TOKENIZER)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer, True), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encoder.encode(text) + end
                for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[a : a + 4 * capacity]
                    out.append((doc_id, k, a // 4, len(ids) // 4, zlib.crc32(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return texts_of(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity), "pieces")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counted = cut.groupBy("length", "bucket").count()
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counted.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    plan = placements(solve(histogram, capacity))
    shared = spark.sparkContext.broadcast(plan)  # a few rows for each length: each step covers a share of one's demand

    before = counted.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    # an equal row of counts for each (length, bucket): not more than buckets x capacity
    ranked = cut.withColumn("own", F.row_number().over(inner) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = np.searchsorted(table["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                here = length == x
                a, b = starts[x], starts[x + 1]
                row[here] = a + np.searchsorted(table["lo"][a:b], rank[here], "right") - 1
            inside = rank - table["lo"][row]
            sequence = table["first"][row] + inside // table["each"][row]
            offset = table["at"][row] + inside % table["each"][row] * length
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all ``documents`` into sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
