"""Ranked lexical search by windows of doc_id.

Documents become postings of the terms that the items ask for, one row a document
with its terms and their occurrences.  The postings are range partitioned by doc_id
and cut into *windows*: at most ``WINDOW`` documents of one fixed range of ``WINDOW``
doc_ids.  Within a window the postings lie by term; an item scatter-adds its terms'
contributions into one array that fits a cache, marks the slots it touches in a
bitset, and harvests those above the least score of its heap of the ``k`` best.  A
task keeps a heap for each item over all its windows, and only what the heaps hold
leaves it.

A term is ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z in lower case.  Its
weight w is floor(1000 ln((2N + 2) / (2 df + 1))); a document's length norm m is
100 - 50 + (50 n N) div L; the score sums w ((10^9 tf) div (1000 tf + 20 m)) over the
item's terms, in 64-bit integers.  All counts are over all documents.

Items are dealt into passes whose texts come to at most ``ITEM_BYTES`` together, so
that what a task holds of them is bounded; each pass reads the documents anew.

Defined cases: a null text has no term; documents without a term count nowhere; rows
with one doc_id are documents of their own and may each be returned; a null doc_id
is last among ties; rows with one item_id are one item with the terms of all of
them; an item without a term, or whose terms no document has, gives no rows; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: doc_ids of a window, and so slots of the array of scores (32 kB).
WINDOW = 4096
#: Bytes of item texts of one pass.
ITEM_BYTES = 16 << 20
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
HIT = "item int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order, as UTF-8: every byte of a character beyond ASCII belongs to a term."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs of documents with a term; ``terms`` are those of ``known``, by number."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # of at most ITEM_BYTES of texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            ids, sizes, lists, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                met = np.fromiter((t for t in map(number, words) if t is not None), np.int32)
                own, tfs = np.unique(met, return_counts=True)
                ids.append(doc_id)
                sizes.append(len(words))
                lists.append(own)
                counts.append(tfs)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "terms": pa.array(lists, pa.list_(pa.int32())), "tfs": pa.array(counts, pa.list_(pa.int64()))}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Heap:
    """The ``k`` best of one item: highest score first, then least doc_id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """Scores below this need not come."""
        return self.rows[0][0] if len(self.rows) == self.k else 1

    def add(self, score: int, doc_id: int | None) -> None:
        row = (score, doc_id is not None, -doc_id if doc_id is not None else 0)
        if len(self.rows) < self.k:
            heapq.heappush(self.rows, row)
        else:
            heapq.heappushpop(self.rows, row)


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of one window each: doc_ids, lengths, and postings (slot, term, tf); rows come by ascending doc_id."""
    ids: list = []
    parts: list[tuple[np.ndarray, ...]] = []
    own = None

    def whole():
        n, sizes, terms, tfs = (np.concatenate(c) for c in zip(*parts, strict=True))
        return ids, n, np.repeat(np.arange(len(ids)), sizes), terms, tfs

    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        names = [None if i is None else i // WINDOW for i in doc_ids]
        columns = [batch.column(c) for c in ("n", "terms", "tfs")]
        start = 0
        while start < len(names):
            if ids and (names[start] != own or len(ids) == WINDOW):
                yield whole()
                ids, parts = [], []
            own, end = names[start], start + 1
            while end < len(names) and names[end] == own and end - start + len(ids) < WINDOW:
                end += 1
            n, terms, tfs = (c.slice(start, end - start) for c in columns)
            parts.append((n.to_numpy(), np.asarray(terms.value_lengths()), terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
            ids = ids + doc_ids[start:end]
            start = end
    if ids:
        yield whole()


def harvest(batches: Iterator[pa.RecordBatch], items: list[np.ndarray], weights: np.ndarray, n_docs: int, length: int, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best documents of this task for each item (number, doc_id, score)."""
    heaps = [Heap(k) for _ in items]
    scores, touched = np.zeros(WINDOW, np.int64), np.zeros(WINDOW // 8, np.uint8)
    for ids, n, slots, terms, tfs in windows(batches):
        norm = 50 + 50 * n * n_docs // length
        gains = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * norm[slots]))
        order = np.argsort(terms, kind="stable")
        terms, slots, gains = terms[order], slots[order], gains[order]
        names, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))
        bytes_, bits = slots >> 3, (128 >> (slots & 7)).astype(np.uint8)
        for item, heap in zip(items, heaps, strict=True):
            at = np.searchsorted(names, item)
            at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == item)] if len(names) else at[:0]
            if not len(at):
                continue
            for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
                scores[slots[a:b]] += gains[a:b]  # a term has a slot once
                np.bitwise_or.at(touched, bytes_[a:b], bits[a:b])
            places = np.flatnonzero(np.unpackbits(touched))
            for place in places[scores[places] >= heap.least()].tolist():
                if scores[place] >= heap.least():
                    heap.add(int(scores[place]), ids[place])
            scores[places] = 0
            touched[:] = 0
    found = [(i, -minus if known else None, score) for i, heap in enumerate(heaps) for score, known, minus in heap.rows]
    columns = list(zip(*found, strict=True)) if found else [(), (), ()]
    yield pa.RecordBatch.from_pydict({"item": pa.array(columns[0], pa.int32()), "doc_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.int64())})


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // ITEM_BYTES)
    found = [_pass(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p), k) for p in range(passes)]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _pass(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    asked: dict[int | None, set[bytes]] = {}
    for r in items.collect():  # about ITEM_BYTES of texts
        asked.setdefault(r["item_id"], set()).update(terms_of(r["text"]))
    known = {t: i for i, t in enumerate(sorted(set().union(*asked.values())))} if asked else {}
    rows = stored(postings(docs, known), "postings")
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    dfs = {r["t"]: r["df"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # of known terms
    weights = np.array([weight(total["docs"], dfs.get(t, 0)) for t in range(len(known))] or [0], np.int64)
    names = list(asked)
    shared = spark.sparkContext.broadcast(([np.array(sorted(known[t] for t in asked[i]), np.int32) for i in names], weights))
    n_docs, length = total["docs"], max(1, total["terms"] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from harvest(batches, *shared.value, n_docs, length, k)

    # equal doc_ids are dealt by what they hold, so that no id is too frequent for a task
    dealt = rows.where(F.size("terms") > 0).withColumn("h", F.xxhash64("n", "terms", "tfs")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id")
    best = dealt.select("doc_id", "n", "terms", "tfs").mapInArrow(run, HIT)
    place = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    numbers = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return best.join(F.broadcast(numbers), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for every ``benchmark`` item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same rows by joins of terms.
OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE text IS NOT NULL),
docs AS MATERIALIZED (SELECT * FROM d WHERE len(ws) > 0),
counts AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS total FROM docs),
asked AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE text IS NOT NULL),
words AS (SELECT r, unnest(ws) AS t FROM docs),
tfs AS MATERIALIZED (SELECT r, t, count(*)::BIGINT AS tf FROM words WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
            FROM (SELECT t, count(*)::BIGINT AS df FROM tfs GROUP BY t), counts),
norms AS (SELECT r, doc_id, 50 + (50 * len(ws) * n_docs) // total AS m FROM docs, counts),
scores AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tfs USING (t) JOIN weights USING (t) JOIN norms USING (r) GROUP BY item_id, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
