"""Labels, vocabularies, class weights and the counting taggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import digits_to_zero, pick
from ..schemas import BINARY_TYPE, HIPAA_TYPES, SENTINELS, UNKNOWN_WORD


def relabel_hipaa(label: str = "type") -> Column:
    """Labels of types that HIPAA does not protect become O."""
    c = F.col(label)
    return F.when((c != "O") & ~F.substring(c, 3, 100).isin(*HIPAA_TYPES), "O").otherwise(c)


def relabel_binary(label: str | Column = "type") -> Column:
    """All classes become one; B and I stay.  Apply the HIPAA relabelling first."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c != "O", F.concat(F.substring(c, 1, 1), F.lit(f"-{BINARY_TYPE}"))).otherwise(c)


def with_label_index(tokens: DataFrame, index: DataFrame, label: str = "type") -> DataFrame:
    """``tokens`` with ``ind``; O is 1, never the padding index 0.  ``index`` has at most 64 rows."""
    known = index.where("ind > 0").select(F.col("label").alias(label), "ind")
    return tokens.join(F.broadcast(known), label, "left")


def with_label(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` (ind) with ``label``."""
    return rows.join(F.broadcast(index), "ind", "left")


def short_sentences(tokens: DataFrame, below: int = 64) -> DataFrame:
    """Tokens of sentences with fewer than ``below`` tokens."""
    sizes = tokens.groupBy("doc_id", "sent_idx").count().where(F.col("count") < below)
    return tokens.join(sizes.select("doc_id", "sent_idx"), ["doc_id", "sent_idx"], "left_semi")


def phi_sentences(tokens: DataFrame, ind: str = "ind") -> DataFrame:
    """(doc_id, sent_idx, has_phi)."""
    return tokens.groupBy("doc_id", "sent_idx").agg((F.max(ind) > 1).alias("has_phi"))


def vocabulary(tokens: DataFrame, *more: DataFrame) -> DataFrame:
    """Distinct words of all inputs without sentinels."""
    for other in more:
        tokens = tokens.select("text").union(other.select("text"))
    return tokens.select(F.col("text").alias("word")).where(~F.col("text").isin(*SENTINELS)).distinct()


def class_weights(labels: DataFrame, size: int, ind: str = "ind") -> DataFrame:
    """(ind, weight): 0 for padding, N / N_O for O, N / (N - N_O) for all others; null where a side is empty."""
    n = labels.agg(F.count("*").cast("double").alias("n"), F.sum((F.col(ind) == 1).cast("double")).alias("o"))
    spark = labels.sparkSession
    weight = F.when(F.col("ind") == 0, 0.0).when(F.col("ind") == 1, F.try_divide("n", "o")).otherwise(F.try_divide(F.col("n"), F.col("n") - F.col("o")))
    return spark.range(size).select(F.col("id").cast("int").alias("ind")).join(F.broadcast(n)).select("ind", weight.alias("weight"))


def label_priors(tokens: DataFrame, label: str = "type") -> DataFrame:
    """(label, n, share)."""
    counted = tokens.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.join(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def word_list_tagger(tokens: DataFrame, label: str = "type") -> DataFrame:
    """(word, label): the most frequent label of each word after one vote for O; of equals the first in order, O before all."""
    counted = tokens.groupBy(F.col("text").alias("word"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    voted = counted.withColumn("n", F.col("n") + (F.col("label") == "O").cast("int"))
    best = voted.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("k"), (F.col("label") != "O").alias("o"), "label")).alias("b"))
    # without a vote of its own O still has one
    return best.select("word", F.when((F.col("b.k") >= -1) & (F.col("b.label") != "O"), "O").otherwise(F.col("b.label")).alias("label"))


def predict_word_list(tokens: DataFrame, model: DataFrame) -> DataFrame:
    """``tokens`` with ``predicted``; unseen words are O."""
    known = model.select(F.col("word").alias("text"), F.col("label").alias("predicted"))
    return tokens.join(known, "text", "left").withColumn("predicted", F.coalesce("predicted", F.lit("O")))


def predict_upper_bound(tokens: DataFrame, known: DataFrame, label: str = "type") -> DataFrame:
    """``tokens`` with the labels of an equal sentence in ``known``; others are null.  Of equal sentences the last (doc_id, sent_idx) counts."""

    def sentences(df: DataFrame, *cols: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("tok_idx", "text", *cols)))
        return df.groupBy("doc_id", "sent_idx").agg(parts.alias("p")).withColumn("s", F.array_join(F.transform("p", lambda x: x["text"]), " "))

    memory = sentences(known, label).groupBy("s").agg(F.max_by(F.transform("p", lambda x: x[label]), F.struct("doc_id", "sent_idx")).alias("labels"))
    found = sentences(tokens).join(memory, "s", "left").select("doc_id", "sent_idx", "labels")
    return tokens.join(found, ["doc_id", "sent_idx"]).withColumn("predicted", F.get("labels", F.col("tok_idx"))).drop("labels")


def predict_by_priors(tokens: DataFrame, priors: DataFrame, salt: str = "0") -> DataFrame:
    """``tokens`` with a label drawn by the priors, deterministic by hash.  ``priors`` has a row for each label."""
    order = W.orderBy("label")  # a row for each label
    steps = priors.withColumn("hi", F.sum("share").over(order)).withColumn("lo", F.col("hi") - F.col("share")).select(F.col("label").alias("predicted"), "lo", "hi")
    u = pick(F.lit(1_000_000), F.col("doc_id"), F.col("sent_idx"), F.col("tok_idx"), F.lit(salt)) / 1e6
    return tokens.withColumn("u", u).join(F.broadcast(steps), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).drop("u", "lo", "hi")


def word_index(words: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with ``ind`` by the first form that ``vocab`` (word, ind) has; else that of the unknown word, else 1.

    Forms in order: as it is, lower case, without signs, every digit 0, runs of digits 0.
    """
    c = F.col(word)
    low = F.lower(c)
    bare = F.regexp_replace(low, r"[^\p{L}\p{N}_]", "")
    forms = F.array(c, low, bare, F.regexp_replace(bare, "[0-9]", "0"), digits_to_zero(bare), F.lit(UNKNOWN_WORD))
    keys = words.select(word).distinct().select(word, F.posexplode(forms).alias("priority", "form"))
    found = keys.join(vocab.select(F.col("word").alias("form"), "ind"), "form").groupBy(word).agg(F.min_by("ind", "priority").alias("ind"), F.min("priority").alias("priority"))
    return words.join(found, word, "left").select(*words.columns, F.coalesce("ind", F.lit(1)).alias("ind"), F.coalesce("priority", F.lit(5)).alias("priority"))


def is_unknown(ind: str = "ind") -> Column:
    return F.col(ind) == 1


def split_reuse(rows: DataFrame, split: str = "split") -> DataFrame:
    """(doc_id, n_splits, splits) of documents that more than one split has."""
    return rows.groupBy("doc_id").agg(F.countDistinct(split).alias("n_splits"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits")).where("n_splits > 1")


def sentence_sizes(tokens: DataFrame) -> DataFrame:
    """One row: n_documents, n_sentences, n_tokens and max_length, the tokens of the longest sentence (0 without any)."""
    each = tokens.groupBy("doc_id", "sent_idx").agg(F.count("*").alias("n"))
    return each.agg(
        F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_sentences"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.coalesce(F.max("n"), F.lit(0)).alias("max_length")
    )
