"""Vectors of words from their character n-grams, for words that a vocabulary lacks.

A word's n-grams are the substrings of ``<word>`` of 3 to 6 characters; each falls into a
bucket by a 32-bit hash of its UTF-8 bytes, and every bucket has a vector.  A word's
vector is the mean over its n-grams, and over its own vector too if the vocabulary has
it.  Only distinct words are taken apart, all inside the JVM; n-grams meet their
vectors by a join on the bucket and are averaged on the way, so neither a frequent
n-gram nor a very long word is gathered anywhere.  A table of vectors that is measured
to be small is broadcast: then n-grams are averaged where their word lies, and none is
exchanged; a large one is joined by exchange of the n-grams.

Defined cases: the null word has no row; the empty word has no n-gram; n-grams whose
bucket has no vector don't count; a word of which nothing is known has the zero vector;
zero vectors get a little noise by ``jittered``, so that they have a direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from .lookup import jittered
from .vectors import normalised

LEAST, MOST = 3, 6
BUCKETS = 2_000_000
#: Bytes of n-gram vectors that are broadcast at most.
BROADCAST_BYTES = 64 << 20
# Offset and prime of the 32-bit hash (FNV-1a).
_OFFSET, _PRIME = 2166136261, 16777619


def ngrams(word: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Substrings of ``<word>`` of ``least`` to ``most`` characters, by length and place, repeats included."""

    none = F.array().cast("array<string>")

    def of_size(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(none)

    def of(w: Column) -> Column:
        return F.when(F.length(w) > 2, F.concat(*(of_size(w, n) for n in range(least, most + 1)))).otherwise(none)

    return bound(F.concat(F.lit("<"), word, F.lit(">")), of)


def bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of an n-gram.  Bytes from 128 on are taken as negative, as the published models take them."""

    def of(digits: Column) -> Column:
        bytes_ = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
        signed = F.transform(bytes_, lambda b: F.when(b < 128, b).otherwise(b + 0xFFFFFF00))
        return F.aggregate(signed, F.lit(_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * _PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))

    return bound(F.hex(F.encode(gram, "UTF-8")), of) % buckets


def word_vectors(words: DataFrame, grams: DataFrame, known: DataFrame, size: int, buckets: int = BUCKETS, l2: bool = True, seed: int = 0) -> DataFrame:
    """word, n_known, vec of every distinct word of ``words``.

    ``grams`` are (bucket, vec) and ``known`` (word, vec), all of ``size`` components.
    ``n_known`` counts the vectors averaged.  With ``l2`` vectors have unit length.
    """
    own = words.select("word").where("word is not null").distinct()
    parts = own.select("word", F.explode(ngrams(F.col("word"))).alias("gram")).groupBy("word", "gram").agg(F.count("*").alias("times"))
    table = grams.where((F.col("bucket") >= 0) & (F.col("bucket") < buckets)).select("bucket", "vec")
    if table.count() * (8 * size + 16) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    found = parts.withColumn("bucket", bucket(F.col("gram"), buckets)).join(table, "bucket").select("word", "times", "vec")
    whole = own.join(known.select("word", "vec"), "word").select("word", F.lit(1).cast("long").alias("times"), "vec")
    sums = [F.sum(F.get("vec", F.lit(i)).cast("double") * F.col("times")).alias(f"s{i}") for i in range(size)]
    means = found.unionByName(whole).groupBy("word").agg(F.sum("times").alias("n_known"), *sums)
    means = means.select("word", "n_known", F.array(*(F.col(f"s{i}") / F.col("n_known") for i in range(size))).alias("vec"))
    out = own.join(means, "word", "left").select("word", F.coalesce("n_known", F.lit(0)).alias("n_known"), F.coalesce("vec", F.array_repeat(F.lit(0.0), size)).alias("vec"))
    out = out.withColumn("vec", jittered("vec", seed, key=F.col("word")))
    return out.withColumn("vec", normalised("vec")) if l2 else out
