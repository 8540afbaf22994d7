"""Spans over text: detection, alignment with tokens, assembly, merging and masking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import with_matches
from ..schemas import PHI_TYPES

#: Tokens of very long documents are matched by buckets of this many characters.
BUCKET = 256


def tag_name(tag_type: str | Column) -> Column:
    """Category of a PHI type, null for unknown ones."""
    c = F.col(tag_type) if isinstance(tag_type, str) else tag_type
    return F.create_map(*(F.lit(x) for pair in PHI_TYPES.items() for x in pair))[c]


def detect(docs: DataFrame, patterns: dict[str, str], needs: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, tag_type, tag_name, start, end, text) of every match of each type's pattern.

    Texts without a match drop out before anything is exchanged.  ``needs`` names, for patterns that
    try every word from each of its letters, a string that all their matches hold: texts without it are not tried.
    """
    parts = []
    for kind, pattern in patterns.items():
        has = F.col("text").rlike(pattern)
        if needs and kind in needs:
            has = F.col("text").contains(needs[kind]) & has
        found = with_matches(docs.where(has), "text", pattern, "doc_id")
        parts.append(found.select("doc_id", F.lit(kind).alias("tag_type"), F.lit(PHI_TYPES.get(kind)).alias("tag_name"), "start", "end", F.col("match").alias("text")))
    return reduce(DataFrame.unionByName, parts)


def numbered(spans: DataFrame, prefix: str = "P", *keys: str) -> DataFrame:
    """``spans`` with an id, numbered in each document from 0 by start."""
    keys = keys or ("doc_id",)
    order = W.partitionBy(*keys).orderBy("start", "end", "tag_type")
    return spans.withColumn("id", F.concat(F.lit(prefix), (F.row_number().over(order) - 1).cast("string")))


def valid_spans(spans: DataFrame) -> DataFrame:
    return spans.where("start is not null and end is not null and start >= 0 and end > start")


def violations(spans: DataFrame) -> DataFrame:
    """Spans that cannot be aligned, with the reason."""
    reason = (
        F.when(F.col("start").isNull() | F.col("end").isNull(), "offset is no integer")
        .when(F.col("start") < 0, "negative offset")
        .when(F.col("end") <= F.col("start"), "no length")
        .when(~F.col("tag_type").isin(*PHI_TYPES), "unknown type")
        .when(F.col("tag_name") != tag_name("tag_type"), "type of another category")
    )
    return spans.withColumn("reason", reason).where("reason is not null")


def bio_align(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """``tokens`` (doc_id, sent_idx, tok_idx, text, start, end) with ``type``: O, B-X or I-X.

    A token that several spans touch belongs to the one that begins first.  In a
    sentence a span is opened by a token that starts with it, lies in it or reaches
    over its start; later tokens of the span continue it.
    """
    keys = ["doc_id", "sent_idx", "tok_idx"]
    return tokens.drop("type").join(touched_tokens(tokens, spans), keys, "left").withColumn("type", F.coalesce("type", F.lit("O")))


def touched_tokens(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, sent_idx, tok_idx and ``type`` of ``bio_align`` of the tokens that a span touches, which are few.

    Joined by document and by bucket of characters, so that a long document is many small joins.
    """
    own = valid_spans(spans).withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("start", "end", "tag_type")))
    own = own.select("doc_id", "ord", "tag_type", F.col("start").alias("s"), F.col("end").alias("e"))

    def buckets(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / BUCKET)))

    keys = ["doc_id", "sent_idx", "tok_idx"]
    # documents without spans, mostly nearly all, go no further
    touched = tokens.select(*keys, "start", "end").join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    near = touched.withColumn("bucket", buckets("start", "end")).join(own.withColumn("bucket", buckets("s", "e")), ["doc_id", "bucket"])
    hit = near.where("start < e and end > s")
    first = hit.groupBy(*keys).agg(F.min(F.struct("ord", "tag_type", "s", "e", "start", "end")).alias("h"))
    first = first.select(*keys, "h.*")
    opener = (F.col("start") == F.col("s")) | ((F.col("start") >= F.col("s")) & (F.col("end") <= F.col("e"))) | (F.col("start") < F.col("s"))
    w = W.partitionBy("doc_id", "sent_idx", "ord").orderBy("tok_idx")
    before = F.max(opener.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    label = F.when(before == 1, F.concat(F.lit("I-"), "tag_type")).when(opener, F.concat(F.lit("B-"), "tag_type")).otherwise("O")
    return first.withColumn("type", label).select(*keys, "type")


def labelled_tokens(docs: DataFrame, spans: DataFrame, cut: Callable[[DataFrame], DataFrame], untouched: bool = True) -> DataFrame:
    """The tokens ``cut(docs)`` of all documents as ``bio_align`` labels them; ``untouched``: those of documents without spans too.

    Documents are told apart before they are cut: all is O where no span lies, so only tokens of the others are exchanged.
    Store ``spans`` first.
    """
    labelled = bio_align(cut(with_spans(docs, spans)), spans)
    if not untouched:
        return labelled
    return labelled.unionByName(cut(without_spans(docs, spans)).withColumn("type", F.lit("O")))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents where a span can be aligned."""
    return docs.join(valid_spans(spans).select("doc_id").distinct(), "doc_id", "left_semi")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents where no span can be aligned."""
    return docs.join(valid_spans(spans).select("doc_id").distinct(), "doc_id", "left_anti")


def bio_to_spans(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, tag_type, start, end, n_tokens) from labelled tokens.

    O closes; I continues a span of its type; B, or an I of another type or without
    a span before it, opens one; a sentence's end closes.
    """
    w = W.partitionBy("doc_id", "sent_idx").orderBy("tok_idx")
    kind = F.when(F.col("type") != "O", F.substring("type", 3, 100))
    rows = tokens.withColumn("tag_type", kind).withColumn("prev", F.lag("tag_type").over(w))
    opens = F.col("type").startswith("B-") | F.col("prev").isNull() | (F.col("prev") != F.col("tag_type"))
    rows = rows.withColumn("span", F.sum(F.when(F.col("tag_type").isNotNull() & opens, 1).otherwise(0)).over(w)).where("tag_type is not null")
    return rows.groupBy("doc_id", "sent_idx", "span", "tag_type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_tokens")).drop("span")


def merge_overlaps(spans: DataFrame, *keys: str, start: str = "start", end: str = "end") -> DataFrame:
    """Islands of spans that overlap or touch: keys, start, end, n, and the type of the first span."""
    w = W.partitionBy(*keys).orderBy(start, end, "tag_type")
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("island", F.sum(F.when(F.col(start) <= reach, 0).otherwise(1)).over(w))
    merged = rows.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"), F.min(F.struct(start, end, "tag_type")).alias("f"))
    return merged.select(*keys, "start", "end", "n", F.col("f.tag_type").alias("tag_type"))


def masked(docs: DataFrame, spans: DataFrame, before: str = "[", after: str = "]", show_text: bool = False) -> DataFrame:
    """(doc_id, text) with every island of spans replaced by its type between marks, or set between marks (``show_text``)."""
    islands = merge_overlaps(valid_spans(spans), "doc_id")
    lists = islands.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag_type"))).alias("spans"))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        inside = F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) if show_text else s["tag_type"]
        kept = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], kept, F.lit(before), inside, F.lit(after)).alias("out"), s["end"].alias("at"))

    both = docs.select("doc_id", "text").join(lists, "doc_id", "left")
    done = F.aggregate("spans", state, step)
    return both.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(done["out"], F.expr("substring(text, aggregate(spans, 0, (a, s) -> s.end) + 1)"))).alias("text"))


def alignment(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` with ``aligned``: the span's own text is the document's slice, line breaks read as blanks at will."""
    slice_ = F.expr("substring(doc_text, start + 1, end - start)")
    both = spans.join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id")
    ok = (F.col("text") == slice_) | (F.col("text") == F.replace(slice_, F.lit("\n"), F.lit(" ")))
    return both.withColumn("aligned", F.coalesce(ok, F.lit(False))).drop("doc_text")


def to_dicts(spans: DataFrame, attributes: list[str]) -> DataFrame:
    """Chosen attributes of each span; those that a table lacks are null."""
    return spans.select("doc_id", *(F.col(a) if a in spans.columns else F.lit(None).cast("string").alias(a) for a in attributes))


def with_gold_text(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Predicted documents with the gold text where there is one."""
    g = gold.select("doc_id", F.col("text").alias("gold_text"))
    return predicted.join(g, "doc_id", "left").withColumn("text", F.coalesce("gold_text", "text")).drop("gold_text")


def shifted_from(spans: DataFrame, first: int, by: int) -> DataFrame:
    """Offset repair: ``end`` moves from the span ``first`` (by ord) on, ``start`` after it."""
    return spans.withColumns({"start": F.when(F.col("ord") > first, F.col("start") + by).otherwise(F.col("start")), "end": F.when(F.col("ord") >= first, F.col("end") + by).otherwise(F.col("end"))})
