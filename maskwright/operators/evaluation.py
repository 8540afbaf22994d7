"""Scores of system spans against gold spans in all variants, from one pass over the exploded spans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import scorer_tokens
from ..schemas import CATEGORIES, HIPAA_TYPES


@dataclass(frozen=True)
class Variant:
    """One way to score: what is counted, by which key, how matched, and which spans take part."""

    name: str
    unit: str  # token or tag
    binary: bool = False  # key without type
    fuzzy: bool = False  # ends may differ by FUZZY
    hipaa: bool = False
    category: str | None = None


FUZZY = 2


def variants() -> list[Variant]:
    """All 42 in their order."""
    out = [Variant("Token", "token"), Variant("Strict", "tag"), Variant("Relaxed", "tag", fuzzy=True)]
    out += [Variant("HIPAA Token", "token", hipaa=True), Variant("HIPAA Strict", "tag", hipaa=True), Variant("HIPAA Relaxed", "tag", fuzzy=True, hipaa=True)]
    out += [Variant("Binary Token", "token", binary=True), Variant("Binary Strict", "tag", binary=True)]
    out += [Variant("Binary HIPAA Token", "token", binary=True, hipaa=True), Variant("Binary HIPAA Strict", "tag", binary=True, hipaa=True)]
    for c in CATEGORIES:
        out += [Variant(f"{c} Token", "token", category=c), Variant(f"{c} Strict", "tag", category=c)]
        out += [Variant(f"{c} HIPAA Token", "token", hipaa=True, category=c), Variant(f"{c} HIPAA Strict", "tag", hipaa=True, category=c)]
    return out


def is_hipaa(hipaa_idnum: bool = False) -> Column:
    return F.col("tag_type").isin(*HIPAA_TYPES, *(["IDNUM"] if hipaa_idnum else []))


def span_tokens(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Scoring tokens of each span's slice of the document, stamped with its name and type, and its side if it has one (``gold``)."""
    side = [c for c in ("gold",) if c in spans.columns]
    both = spans.join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id")
    cut = both.select("doc_id", *side, "tag_name", "tag_type", F.col("start").alias("s0"), F.col("end").alias("e0"), F.expr("substring(doc_text, start + 1, end - start)").alias("slice")).distinct()
    rows = scorer_tokens(cut, "slice", "doc_id", *side, "tag_name", "tag_type", "s0", "e0")
    return rows.select("doc_id", *side, "tag_name", "tag_type", (F.col("s0") + F.col("start")).alias("start"), (F.col("s0") + F.col("end")).alias("end"))


def _both_sides(docs: DataFrame, gold: DataFrame, system: DataFrame, user: Column | None) -> DataFrame:
    """Spans of both sides that pass ``user``, with ``gold`` (1 or 0), of those documents alone.

    They are exchanged after they are put together.  Spark takes a union of sides that are partitioned alike to be partitioned
    so too, but reads the partitions of each side in numbers of its own, and spans of one document would not meet.
    """
    passed = [(spans.where(user) if user is not None else spans).select("doc_id", "tag_name", "tag_type", "start", "end", F.lit(flag).alias("gold")) for flag, spans in ((1, gold), (0, system))]
    return passed[0].unionByName(passed[1]).join(docs.select("doc_id"), "doc_id", "left_semi").repartition("doc_id", "start")


def _exploded(units: DataFrame, which: list[Variant]) -> DataFrame:
    """(variant, doc_id, key, gold): each unit once for every variant it takes part in."""
    full = F.concat_ws("|", "tag_name", "start", "end", F.upper("tag_type"))
    place = F.concat_ws("|", "start", "end")
    parts = []
    for v in which:
        take = F.lit(True)
        if v.hipaa:
            take = take & F.coalesce(is_hipaa(), F.lit(False))
        if v.category:
            take = take & F.coalesce(F.col("tag_name") == v.category, F.lit(False))
        parts.append(F.when(take, F.struct(F.lit(v.name).alias("variant"), (place if v.binary else full).alias("key"))))
    return units.select("doc_id", "gold", F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.variant", "doc_id", "x.key", "gold")


def counts(docs: DataFrame, gold: DataFrame, system: DataFrame, which: list[Variant] | None = None, user: Column | None = None) -> DataFrame:
    """(variant, doc_id, tp, fp, fn) of documents that have any.

    ``docs`` are those that both sides know; others don't count.  ``user`` filters
    spans in every variant, besides the variant's own filter.
    """
    which = which or variants()
    exact = [v for v in which if not v.fuzzy]
    both = _both_sides(docs, gold, system, user)
    rows = _exploded(both, [v for v in exact if v.unit == "tag"])
    if wanted := [v for v in exact if v.unit == "token"]:
        rows = rows.unionByName(_exploded(span_tokens(docs, both), wanted))
    merged = rows.groupBy("variant", "doc_id", "key").agg(F.max("gold").alias("g"), F.max(1 - F.col("gold")).alias("s"))
    out = merged.groupBy("variant", "doc_id").agg(
        F.sum(F.col("g") * F.col("s")).alias("tp"), F.sum(F.col("s") * (1 - F.col("g"))).alias("fp"), F.sum(F.col("g") * (1 - F.col("s"))).alias("fn")
    )
    fuzzy = [v for v in which if v.fuzzy]
    return out.unionByName(relaxed_counts(docs, gold, system, fuzzy, user)) if fuzzy else out


def of_every(found: DataFrame, which: list[Variant] | None = None) -> DataFrame:
    """``found`` by variant with a row for each variant, nulls where there is none; 42 rows at most, so the join may broadcast."""
    names = found.sparkSession.createDataFrame([(v.name,) for v in which or variants()], "variant string")
    return names.join(F.broadcast(found), "variant", "left")


def relaxed_counts(docs: DataFrame, gold: DataFrame, system: DataFrame, which: list[Variant], user: Column | None = None) -> DataFrame:
    """Counts when ends may differ by ``FUZZY``: a side's span counts as matched if any of the other's fits.

    Spans of both sides that start together meet in one aggregate, as two sets of ends; all variants come from it.
    """
    both = _both_sides(docs, gold, system, user).withColumn("tag_type", F.upper("tag_type"))
    ends = lambda flag: F.collect_set(F.when(F.col("gold") == flag, F.col("end")))
    met = both.groupBy("doc_id", "tag_name", "tag_type", "start").agg(ends(1).alias("g"), ends(0).alias("s"))
    lone = lambda own, other: F.size(F.filter(own, lambda x: ~F.exists(other, lambda y: F.abs(x - y) <= FUZZY)))
    names = F.array_compact(F.array(*(F.when(F.coalesce(is_hipaa(), F.lit(False)) if v.hipaa else F.lit(True), F.lit(v.name)) for v in which)))
    counted = met.select("doc_id", F.explode(names).alias("variant"), F.size("s").alias("n"), lone("s", "g").alias("fp"), lone("g", "s").alias("fn"))
    return counted.groupBy("variant", "doc_id").agg(F.sum(F.col("n") - F.col("fp")).alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    """a / (a + b), 0 where there is nothing."""
    return F.coalesce(F.try_divide(a.cast("double"), (a + b).cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def per_document(found: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("fp")), ratio(F.col("tp"), F.col("fn"))
    return found.select("variant", "doc_id", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"))


def micro(found: DataFrame, which: list[Variant] | None = None) -> DataFrame:
    """variant, tp, fp, fn, precision, recall, f1 over all documents; a row of zeros for a variant without spans."""
    sums = of_every(found.groupBy("variant").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn"))), which).fillna(0)
    p, r = ratio(F.col("tp"), F.col("fp")), ratio(F.col("tp"), F.col("fn"))
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro(found: DataFrame, docs: DataFrame, which: list[Variant] | None = None) -> DataFrame:
    """variant, mean and population deviation of precision and recall over all documents, and F1 of the means.

    Documents without a span count as 0; so sums over those that have some suffice.
    """
    n = docs.select("doc_id").distinct().agg(F.count("*").alias("n"))
    each = per_document(found)
    sums = each.groupBy("variant").agg(*(F.sum(c).alias(c) for c in ("precision", "recall")), *(F.sum(F.col(c) * F.col(c)).alias(f"{c}2") for c in ("precision", "recall")))
    both = of_every(sums, which).fillna(0.0).join(F.broadcast(n))  # one row
    mean = {c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0)) for c in ("precision", "recall")}
    sd = {c: F.sqrt(F.greatest(F.coalesce(F.try_divide(F.col(f"{c}2"), F.col("n")), F.lit(0.0)) - mean[c] * mean[c], F.lit(0.0))) for c in mean}
    return both.select("variant", mean["precision"].alias("precision"), sd["precision"].alias("precision_sd"), mean["recall"].alias("recall"), sd["recall"].alias("recall_sd")).withColumn(
        "f1", f1(F.col("precision"), F.col("recall"))
    )


def difference_report(gold: DataFrame, system: DataFrame) -> DataFrame:
    """Spans that one side alone has: doc_id, tag_type, start, end, text, side."""
    cols = ["doc_id", "tag_type", "start", "end", "text"]
    g, s = gold.select(cols), system.select(cols)
    return g.subtract(s).withColumn("side", F.lit("gold")).unionByName(s.subtract(g).withColumn("side", F.lit("system")))


def text_differences(gold: DataFrame, system: DataFrame) -> DataFrame:
    """(doc_id, n_gold, n_system, first_difference) of documents that both sides have with unlike texts, whose offsets then don't agree.

    Lengths and the first place that differs are code points; a null text is unlike any but null.
    """
    both = gold.select("doc_id", F.col("text").alias("g")).join(system.select("doc_id", F.col("text").alias("s")), "doc_id").where(~F.col("g").eqNullSafe(F.col("s")))
    # by halves: a prefix agrees or not, and 31 steps cover any length
    step = lambda acc, k: F.when(F.substring("g", 1, acc + k) == F.substring("s", 1, acc + k), acc + k).otherwise(acc)
    powers = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    shorter = F.least(F.length("g"), F.length("s"))
    same = F.aggregate(powers, F.lit(0), lambda acc, k: F.when(acc + k <= shorter, step(acc, k)).otherwise(acc))
    return both.select("doc_id", F.length("g").alias("n_gold"), F.length("s").alias("n_system"), same.alias("first_difference"))


def document_report(found: DataFrame, docs: DataFrame, variant: str = "Strict") -> DataFrame:
    """(doc_id, tp, fp, fn, precision, recall, f1) of every document for one variant; documents without spans have zeros."""
    own = per_document(found.where(F.col("variant") == variant)).drop("variant")
    rows = docs.select("doc_id").distinct().join(own, "doc_id", "left").fillna(0, ["tp", "fp", "fn"]).fillna(0.0, ["precision", "recall"])
    return rows.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")), "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"))


def missing_documents(gold: DataFrame, system: DataFrame) -> DataFrame:
    """Documents that one side alone has; scoring leaves them out."""
    g, s = gold.select("doc_id").distinct(), system.select("doc_id").distinct()
    return g.join(s, "doc_id", "left_anti").withColumn("missing_in", F.lit("system")).unionByName(s.join(g, "doc_id", "left_anti").withColumn("missing_in", F.lit("gold")))


def reported(names: Column, binary: bool = False, hipaa: bool = False) -> Column:
    """Which variants a summary shows: binary runs show binary ones alone, HIPAA runs HIPAA ones alone."""
    shown = F.lit(True)
    if binary:
        shown = shown & names.contains("Binary")
    if hipaa:
        shown = shown & names.contains("HIPAA")
    return shown


def subsequences(inner: DataFrame, outer: DataFrame, *keys: str) -> DataFrame:
    """(keys, subsequence): whether every scoring token of ``inner`` is one of ``outer``, for keys that ``inner`` has.

    Both are (keys, start, end).  Tokens are compared by place; no group is collected.
    """
    known = outer.select(*keys, "start", "end").distinct().withColumn("_known", F.lit(True))
    rows = inner.join(known, [*keys, "start", "end"], "left")
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.col("_known").isNotNull()), F.lit(True)).alias("subsequence"))


def token_places(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Scoring tokens of each span with ``place``, the token's number in its document, null where the document has no such token."""
    own = scorer_tokens(docs, "text", "doc_id").select("doc_id", F.col("idx").alias("place"), "start", "end")
    return span_tokens(docs, spans).join(own, ["doc_id", "start", "end"], "left").select("doc_id", "tag_name", "tag_type", "start", "end", "place")
