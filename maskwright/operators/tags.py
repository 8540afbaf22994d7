"""Tags beside PHI: clinical risk tags, document-level tags, filters and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What the attributes of clinical tags may be, by tag name.
_TIMES = ("before dct", "during dct", "after dct", "continuing")
CLINICAL = {
    "FAMILY_HIST": {"indicator": ("present", "not present")},
    "SMOKER": {"status": ("current", "past", "ever", "never", "unknown")},
    "OBESE": {"time": _TIMES, "indicator": ("mention", "bmi", "waist circum.")},
    "HYPERTENSION": {"time": _TIMES, "indicator": ("mention", "high bp")},
    "HYPERLIPIDEMIA": {"time": _TIMES, "indicator": ("mention", "high chol.", "high ldl", "high-ldl", "high-chol")},
    "DIABETES": {"time": _TIMES, "indicator": ("mention", "a1c", "glucose")},
    "CAD": {"time": _TIMES, "indicator": ("mention", "event", "test", "symptom")},
    "MEDICATION": {
        "time": _TIMES,
        "type1": ("ace inhibitor", "amylin", "anti diabetes", "arb", "aspirin", "beta blocker", "calcium channel blocker", "diuretic", "dpp4 inhibitors", "ezetimibe", "fibrate", "glp1 agonists",
                  "meglitinides", "insulin", "metformin", "niacin", "nitrate", "obesity", "statin", "sulfonylureas", "thiazolidinedione", "thienopyridine"),
    },
}
ATTRIBUTES = ("time", "indicator", "status", "type1", "type2")


def compile_filter(value: str) -> Column:
    """A filter value as a predicate: a tag name, else a value that some clinical attribute may have.  Case does not matter; unknown values are an error."""
    v = value.strip().lower()
    if v.upper() in CLINICAL or v.upper() in ("PHI", "NAME", "PROFESSION", "LOCATION", "AGE", "DATE", "CONTACT", "ID", "OTHER"):
        return F.lower("tag_name") == v
    where = {a for spec in CLINICAL.values() for a, values in spec.items() if v in values}
    if "type1" in where:
        where.add("type2")
    if not where:
        raise ValueError(f"no tag or attribute has the value {value!r}")
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(a) == v, F.lit(False)) for a in sorted(where)))


def combined(predicates: list[Column], conjunctive: bool = False, invert: bool = False) -> Column:
    """Any predicate, or all if conjunctive; the whole turned round if inverted.  Without predicates everything passes."""
    if not predicates:
        return F.lit(True)
    whole = reduce((lambda a, b: a & b) if conjunctive else (lambda a, b: a | b), predicates)
    return ~whole if invert else whole


def family_history_default() -> Column:
    """The indicator; where it is missing, present if both offsets are given."""
    return F.coalesce("indicator", F.when((F.col("start") != -1) & (F.col("end") != -1), "present").otherwise("not present"))


def key_columns(tag: str = "tag_name") -> Column:
    """Document-level key: lower case, attributes by name; the two types of a medication are an unordered pair."""
    a, b = F.lower(F.coalesce("type1", F.lit(""))), F.lower(F.coalesce("type2", F.lit("")))
    rest = [F.lower(F.coalesce(c, F.lit(""))) for c in ("time", "indicator", "status")]
    return F.concat_ws("|", F.lower(tag), *rest, F.greatest(a, b), F.least(a, b))


def document_tags(tags: DataFrame) -> DataFrame:
    """(doc_id, key, id, n): annotator tags of one key as one tag of the document, ids in the order of keys."""
    grouped = tags.groupBy("doc_id", key_columns().alias("key")).agg(F.count("*").alias("n"))
    return grouped.withColumn("id", F.concat(F.lit("DOC"), (F.row_number().over(W.partitionBy("doc_id").orderBy("key")) - 1).cast("string")))


def annotator_tags(tags: DataFrame, document_level: DataFrame) -> DataFrame:
    """Tags with offsets; for documents that have none, those inside their document-level tags (array ``tags``)."""
    flat = document_level.join(tags.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.explode("tags").alias("t")).select("doc_id", "t.*")
    return tags.unionByName(flat, allowMissingColumns=True)


def clinical_violations(tags: DataFrame) -> DataFrame:
    """(doc_id, tag_name, attribute, value) of attribute values that a tag may not have; the tags themselves stay."""
    rules = []
    for name, spec in CLINICAL.items():
        for attribute, values in spec.items():
            for a in ("type1", "type2") if attribute == "type1" else (attribute,):
                bad = (F.upper("tag_name") == name) & F.col(a).isNotNull() & (F.col(a) != "") & ~F.lower(a).isin(*values)
                rules.append(F.when(bad, F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value"))))
    return tags.select("doc_id", "tag_name", F.explode(F.array_compact(F.array(*rules))).alias("x")).select("doc_id", "tag_name", "x.*")


def cardiac_counts(docs: DataFrame, gold: DataFrame, system: DataFrame) -> DataFrame:
    """(doc_id, tp, fp, fn) over sets of document-level keys; texts are not compared."""
    sides = []
    for flag, tags in ((1, gold), (0, system)):
        sides.append(tags.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", key_columns().alias("key"), F.lit(flag).alias("gold")))
    merged = sides[0].unionByName(sides[1]).groupBy("doc_id", "key").agg(F.max("gold").alias("g"), F.max(1 - F.col("gold")).alias("s"))
    return merged.groupBy("doc_id").agg(F.sum(F.col("g") * F.col("s")).alias("tp"), F.sum(F.col("s") * (1 - F.col("g"))).alias("fp"), F.sum(F.col("g") * (1 - F.col("s"))).alias("fn"))
