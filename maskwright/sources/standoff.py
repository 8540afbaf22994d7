"""Stand-off XML: documents whose text is followed by tags with offsets into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CATEGORIES

#: NNN-NN.xml: patient, record, and what follows names the system.
FILE_NAME = r"([0-9]+)-([0-9]+)([^/]*)\.xml$"
PHI_ELEMENTS = (*CATEGORIES, "PHI")
ATTRIBUTES = ("id", "start", "end", "text", "TYPE", "comment", "time", "indicator", "status", "type1", "type2")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, patient_id, record_id, sys_id, path, xml); whole files, since offsets count every character."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("xml"), F.col("_metadata.file_path").alias("path"))
    part = lambda i: F.regexp_extract("path", FILE_NAME, i)
    files = files.where(F.col("path").rlike(FILE_NAME))
    return files.select(F.concat(part(1), F.lit("-"), part(2)).alias("doc_id"), part(1).alias("patient_id"), part(2).alias("record_id"), part(3).alias("sys_id"), "path", "xml")


def documents(files: DataFrame) -> DataFrame:
    """doc_id, patient_id, record_id, sys_id, text."""
    return files.select("doc_id", "patient_id", "record_id", "sys_id", F.xpath_string("xml", F.lit("/*/TEXT")).alias("text"))


def tags(files: DataFrame) -> DataFrame:
    """A row for each element below TAGS in document order; attributes that an element lacks are null, offsets that are no integers too."""
    n = F.xpath_int("xml", F.lit("count(/*/TAGS/*)"))
    counted = files.select("doc_id", "sys_id", "xml", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("k"))

    # element by element, so one that lacks an attribute doesn't shift the others
    pieces = counted.withColumn("body", F.regexp_extract("xml", r"(?s)<TAGS\b[^>]*>(.*)</TAGS>", 1))
    elements = F.regexp_extract_all("body", F.lit(r"(?s)<([A-Za-z_]+)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"), F.lit(0))
    rows = pieces.withColumn("element", F.get(F.filter(elements, lambda e: ~e.startswith("</")), F.col("k") - 1))
    single = F.concat(F.regexp_replace("element", r"/?>$", ""), F.lit("/>"))
    rows = rows.select("doc_id", "sys_id", (F.col("k") - 1).alias("ord"), F.regexp_extract("element", "^<([A-Za-z_]+)", 1).alias("tag_name"), single.alias("e"))
    has = lambda a: F.xpath_boolean("e", F.lit(f"/*/@{a}"))
    value = lambda a: F.when(has(a), F.xpath_string("e", F.lit(f"/*/@{a}")))
    out = rows.select("doc_id", "sys_id", "ord", "tag_name", *(value(a).alias("tag_type" if a == "TYPE" else a) for a in ATTRIBUTES))
    return out.withColumns({c: F.expr(f"try_cast(`{c}` as int)") for c in ("start", "end")})


def phi_tags(all_tags: DataFrame) -> DataFrame:
    return all_tags.where(F.col("tag_name").isin(*PHI_ELEMENTS))


def annotator_level(all_tags: DataFrame) -> DataFrame:
    """Risk tags that have offsets."""
    return all_tags.where(~F.col("tag_name").isin(*PHI_ELEMENTS) & F.col("start").isNotNull() & F.col("end").isNotNull())


def document_level(all_tags: DataFrame) -> DataFrame:
    """Risk tags without offsets."""
    return all_tags.where(~F.col("tag_name").isin(*PHI_ELEMENTS) & (F.col("start").isNull() | F.col("end").isNull()))
