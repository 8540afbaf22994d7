"""Vector lookup by word and by sentence, and padded sequences.

Defined cases: a word that several sources know takes the first source's vector; a
word that none knows is an error where its vector is read.  Null words are unknown.
Empty sequences stay empty and get no chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .vectors import gaussian_noise, norm


@dataclass(frozen=True)
class Statistics:
    """What is declared of a kind of vectors: components, mean and deviation."""

    size: int
    mean: float
    std: float


# Declared sizes, means and deviations by kind of vectors.
STATISTICS = {
    "elmo": Statistics(1024, 0.0, 0.47),
    "fasttext": Statistics(300, 0.0, 0.05),
    "glove": Statistics(300, 0.0, 0.37),
    "dummy": Statistics(5, 0.0, 0.5),
}


def statistics(kind: str) -> Statistics:
    """Declared statistics by name; an unknown kind is an error."""
    if kind not in STATISTICS:
        raise ValueError(f"unknown kind of vectors {kind!r}: one of {', '.join(STATISTICS)}")
    return STATISTICS[kind]


def word_vectors(words: DataFrame, *sources: DataFrame) -> DataFrame:
    """``words`` (word and any other columns) with ``vec`` and ``source``, the number of the source that knows it.

    Each source is (word, vec); a cache comes before what it was made from.
    """
    out, found, which = words, F.lit(None), F.lit(None).cast("int")
    for k, source in enumerate(sources):
        out = out.join(source.select("word", F.col("vec").alias(f"_v{k}")), "word", "left")
    found = F.coalesce(*(F.col(f"_v{k}") for k in range(len(sources))))
    which = F.coalesce(*(F.when(F.col(f"_v{k}").isNotNull(), F.lit(k)) for k in range(len(sources))))
    unknown = F.raise_error(F.concat(F.lit("no vector for "), F.coalesce("word", F.lit("null")), F.lit("; build the cache anew")))
    return out.select(*words.columns, F.when(found.isNull(), unknown).otherwise(found).alias("vec"), which.alias("source"))


def vector_cache(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """(word, vec) of a vocabulary's own words, to be written once and looked up in first."""
    return vectors.join(words.select("word").distinct(), "word", "left_semi").select("word", "vec")


#: Bytes of vectors of frequent words that are broadcast, and the share of all tokens from which on a word is frequent.
HEAD_BYTES, HEAD_SHARE = 16 << 20, 1e-3


def resolved(words: DataFrame, *sources: DataFrame) -> DataFrame:
    """word, n, vec, source of every distinct word: each is looked up once, however often it occurs."""
    counted = words.where("word is not null").groupBy("word").agg(F.count("*").alias("n"))
    return word_vectors(counted, *sources)


def attached(words: DataFrame, found: DataFrame, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """``words`` with ``vec`` and ``source`` of ``found`` (word, n, vec, source).

    Frequent words, as many as have vectors of ``head_bytes`` together, meet their
    rows by broadcast where these lie; there are at most 1 / HEAD_SHARE of them.
    Only the rows of all other words are exchanged, and none of those words is frequent.
    """
    total = found.agg(F.sum("n").alias("total"), F.max(F.size("vec")).alias("size")).first()
    most = max(1, head_bytes // (8 * (total["size"] or 1) + 64))
    frequent = found.where(F.col("n") > HEAD_SHARE * (total["total"] or 0)).orderBy(F.desc("n"), "word").limit(most)
    head = stored(frequent.select("word", F.struct("vec", "source").alias("_head")), "head")
    near = words.join(F.broadcast(head), "word", "left")
    columns = [F.col(c) for c in words.columns]
    known = near.where("_head is not null").select(*columns, F.col("_head.vec").alias("vec"), F.col("_head.source").alias("source"))
    rest = near.where("_head is null").select(*columns).join(found.select("word", "vec", "source"), "word", "left").select(*columns, "vec", "source")
    return known.unionByName(rest)


def save_cache(found: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Write ``found`` (word, vec) as table ``name`` at ``path``, bucketed and sorted by word, so that later joins by word don't exchange it."""
    found.select("word", "vec").repartition(buckets, "word").write.bucketBy(buckets, "word").sortBy("word").mode("overwrite").option("path", path).saveAsTable(name)


def saved_cache(spark: SparkSession, name: str) -> DataFrame:
    """(word, vec) of a saved cache."""
    return spark.table(name)


def sentence_matrix(tokens: DataFrame, *sources: DataFrame, sentence: tuple[str, ...] = ("doc_id", "sent_idx"), order: str = "tok_idx") -> DataFrame:
    """A row for each sentence with ``matrix``, its words' vectors in order.  A sentence is what one task can hold."""
    found = word_vectors(tokens, *sources)
    rows = found.groupBy(*sentence).agg(F.array_sort(F.collect_list(F.struct(order, "vec"))).alias("m"))
    return rows.select(*sentence, F.transform("m", lambda x: x["vec"]).alias("matrix"))


def cached_sentences(sentences: DataFrame, cache: DataFrame, words: str = "words") -> DataFrame:
    """``sentences`` with ``value`` of ``cache`` (sentence, value), found by the words joined with spaces; a miss is an error.

    Sentences whose words differ only in where spaces lie share an entry.
    """
    own = sentences.withColumn("_s", F.array_join(words, " ")).join(cache.select(F.col("sentence").alias("_s"), F.struct("value").alias("_hit")), "_s", "left")
    miss = F.raise_error(F.concat(F.lit("no entry for "), F.col("_s"), F.lit("; build the cache anew")))
    return own.select(*sentences.columns, F.when(F.col("_hit").isNull(), miss).otherwise(F.col("_hit.value")).alias("value"))


def jittered(vec: str, seed: int, scale: float = 1e-6, key: Column | None = None) -> Column:
    """The zero vector with a little noise, by ``key`` if there is one, so that it has a direction; other vectors as they are."""
    doubles = F.transform(vec, lambda x: x.cast("double"))
    return F.when(norm(vec) == 0, gaussian_noise(vec, scale, seed, key=key)).otherwise(doubles)


def padded(rows: DataFrame, words: str = "words", batch: str | None = None) -> DataFrame:
    """``rows`` with ``n_words`` and ``padded``: empty words behind, up to the size of the longest row of its ``batch``.

    Without a ``batch`` column the table is one batch; that is for tables of sentences, since one very long row would make all as long.
    """
    sized = rows.withColumn("n_words", F.size(words))
    keys = [batch] if batch else []
    longest = sized.groupBy(*keys).agg(F.max("n_words").alias("_most"))
    out = sized.join(longest, batch) if batch else sized.join(F.broadcast(longest))
    fill = F.array_repeat(F.lit(""), (F.col("_most") - F.col("n_words")).cast("int"))
    return out.withColumn("padded", F.concat(words, fill)).drop("_most")


def unpadded(words: str = "padded", size: str = "n_words") -> Column:
    """The first ``size`` members."""
    return F.slice(words, F.lit(1), F.col(size))


def chunked(rows: DataFrame, size: int, words: str = "words") -> DataFrame:
    """A row for every ``size`` members in order, with ``chunk`` from 0 and the members as ``words``; the last may be shorter."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.floor((F.size(words) - 1) / size).cast("int")))
    parts = F.transform(starts, lambda k: F.slice(words, k * size + 1, size))
    return rows.select(*(c for c in rows.columns if c != words), F.posexplode(parts).alias("chunk", words))


def unpadded_matrix(matrix: str, predictions: str) -> tuple[Column, Column]:
    """The last rows of a left-padded matrix, as many as have a component other than 0, and as many last predictions."""
    length = F.size(F.filter(matrix, lambda row: F.exists(row, lambda x: x != 0)))
    last = lambda c: F.slice(c, F.size(c) - length + 1, length)
    return last(matrix), last(predictions)
