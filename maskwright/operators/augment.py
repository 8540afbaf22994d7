"""Pseudonymisation: which words are replaced, and by what.  Random choices are md5 picks, so results repeat."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import DIGITS, PUNCTUATION, pick
from .vectors import gaussian_noise, normalised

#: Word strategies replace at most so many words of a sentence.
MOST_WORDS = 10_000


def default_exclude(word: str | Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Stop words, and words of signs alone, the empty word among them."""
    c = F.col(word) if isinstance(word, str) else word
    out = c.rlike(PUNCTUATION)
    return out | F.lower(c).isin(*stop_words) if stop_words else out


def eligible(word: str = "text", label: str = "type", *, augment_all: bool = False, exclude: Column | None = None, unknown: Column | None = None) -> Column:
    """Whether a word may be replaced: not excluded, labelled unless all are to be, and known if unknown ones stay."""
    out = ~(default_exclude(word) if exclude is None else exclude)
    if not augment_all:
        out = out & (F.col(label) != "O")
    return out & ~unknown if unknown is not None else out


def is_digits(word: str = "text") -> Column:
    return F.col(word).rlike(DIGITS)


def neighbour_words(neighbours: DataFrame, n: int) -> DataFrame:
    """(word, options): the nearest ``n`` words of each word in order, from (query, rank, id)."""
    top = neighbours.where(F.col("rank") <= n).groupBy(F.col("query").alias("word")).agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("o"))
    return top.select("word", F.transform("o", lambda x: x["id"]).alias("options"))


def pseudonyms(tokens: DataFrame, options: DataFrame, alternatives: int = 1, consistent: bool = False, most: int = MOST_WORDS) -> DataFrame:
    """``alternatives`` versions of every sentence that has a replaceable word.

    ``tokens``: doc_id, sent_idx, tok_idx, text, eligible (boolean).  A word takes one
    of its options, chosen by word alone if ``consistent``, else by place and
    version.  At most ``most`` words of a sentence change, those with the least hash.
    Words without options stay.  ``take`` says which words were open to change.
    """
    some = tokens.groupBy("doc_id", "sent_idx").agg(F.max(F.col("eligible").cast("int")).alias("any")).where("any = 1").select("doc_id", "sent_idx")
    rows = tokens.join(some, ["doc_id", "sent_idx"], "left_semi").withColumn("alt", F.explode(F.sequence(F.lit(0), F.lit(alternatives - 1))))
    order = F.md5(F.concat_ws("|", "doc_id", "sent_idx", "tok_idx", "alt"))
    w = W.partitionBy("doc_id", "sent_idx", "alt", "eligible").orderBy(order, "tok_idx")
    rows = rows.withColumn("take", F.col("eligible") & (F.row_number().over(w) <= most))
    keys = [F.col("text")] if consistent else [F.col("doc_id"), F.col("sent_idx"), F.col("tok_idx"), F.col("alt"), F.col("text")]
    joined = rows.join(options.select(F.col("word").alias("text"), "options"), "text", "left")
    chosen = F.get("options", pick(F.size("options"), *keys).cast("int"))
    return joined.withColumn("new_text", F.when(F.col("take") & F.col("options").isNotNull(), chosen).otherwise(F.col("text"))).drop("options")


def random_digits(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """``words`` (word) with ``new_word``: for words of digits, one of the vocabulary's words of digits."""
    digits = vocab.where(F.col("word").rlike("^[0-9]+$")).select("word").distinct()
    ordered = numbered_words(digits)
    n = digits.agg(F.count("*").alias("n"))  # one row
    rows = words.join(F.broadcast(n)).withColumn("i", F.when(is_digits("word") & (F.col("n") > 0), pick(F.col("n"), F.col("word"))))
    return rows.join(ordered.select("i", F.col("word").alias("new")), "i", "left").withColumn("new_word", F.coalesce("new", "word")).drop("i", "n", "new")


def numbered_words(words: DataFrame) -> DataFrame:
    """Words numbered from 0 in order, in two steps: within first characters, then before them."""
    first = F.substring("word", 1, 2)
    own = words.withColumn("b", first).withColumn("r", F.row_number().over(W.partitionBy("b").orderBy("word")) - 1)
    sizes = own.groupBy("b").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(W.orderBy("b")) - F.col("c"))  # at most 110 rows
    return own.join(F.broadcast(sizes), "b").select("word", (F.col("before") + F.col("r")).alias("i"))


@dataclass(frozen=True)
class Strategy:
    """A parsed strategy: whether it works on words or on vectors, and its expression on a vector column."""

    name: str
    on_words: bool
    amount: float | None = None
    unit_length: bool = True

    def vector(self, column: str, seed: int = 0, key: Column | None = None) -> Column:
        """``key`` tells rows apart; without it equal vectors get equal noise."""
        if self.name == "zeros":
            return F.transform(F.zip_with(gaussian_noise(column, 1.0, seed, key=key), column, lambda a, b: a - b), lambda x: x * 1e-6)
        if self.name == "additive_noise":
            return normalised(gaussian_noise(column, self.amount or 0.0, seed, key=key))
        if self.name == "random_embedding":
            zero = F.transform(column, lambda x: x.cast("double") * 0)
            noise = F.zip_with(gaussian_noise(column, self.amount or 1.0, seed, key=key), F.transform(column, lambda x: x.cast("double")), lambda a, b: a - b)
            out = F.zip_with(zero, noise, lambda a, b: a + b)
            return normalised(out) if self.unit_length else out
        raise ValueError(f"{self.name} works on words")


def parse_strategy(name: str | None) -> Strategy | None:
    """``move_to_neighbor-N``, ``additive_noise-S``, ``random_embedding[-S[-l2]]``, ``random_digits``, ``zeros``, None."""
    if name is None:
        return None
    if m := re.fullmatch(r"move_to_neighbor-([0-9]+)", name):
        return Strategy("move_to_neighbor", True, int(m[1]))
    if m := re.fullmatch(r"additive_noise-([0-9.]+)", name):
        return Strategy("additive_noise", False, float(m[1]))
    if m := re.fullmatch(r"random_embedding(?:-([0-9.]+)(-l2)?)?", name):
        return Strategy("random_embedding", False, float(m[1]) if m[1] else None, m[1] is None or m[2] is not None)
    if name == "random_digits":
        return Strategy("random_digits", True)
    if name == "zeros":
        return Strategy("zeros", False)
    raise ValueError(f"unknown strategy {name!r}")
