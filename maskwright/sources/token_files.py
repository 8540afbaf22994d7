"""Token CSV with sibling text, and word-vector files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.vectors import normalised

CSV_SCHEMA = "text string, type string, start int, end int"
STEM = r"([^/]+)\.[A-Za-z0-9]+$"


def _stem():
    return F.regexp_extract("path", STEM, 1)


def read_token_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(doc_id, ord, text, type, start, end) with sentinels; ``limit`` files by name, exactly.

    Spark promises no order of rows, so ``ord`` is made from offsets: at equal
    places ``<s>`` comes first and ``</s>`` last.
    """
    rows = spark.read.csv(path, schema=CSV_SCHEMA, header=True, quote='"', escape='"', multiLine=True).select("*", F.col("_metadata.file_path").alias("path"))
    rows = rows.select(_stem().alias("doc_id"), "text", "type", "start", "end")
    if limit is not None:
        rows = rows.join(F.broadcast(rows.select("doc_id").distinct().orderBy("doc_id").limit(limit)), "doc_id", "left_semi")
    kind = F.when(F.col("text") == "<s>", 0).when(F.col("text") == "</s>", 2).otherwise(1)
    # an end sentinel carries the start of the last token
    order = W.partitionBy("doc_id").orderBy("start", kind, "end")
    return rows.withColumn("ord", F.row_number().over(order) - 1)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of whole text files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return rows.select(_stem().alias("doc_id"), "text")


def triples(csv: DataFrame, txt: DataFrame, xml: DataFrame) -> DataFrame:
    """Documents that have all three files."""
    return csv.select("doc_id").distinct().join(txt, "doc_id").join(xml.select("doc_id", "xml"), "doc_id")


def read_word_vectors(spark: SparkSession, path: str, header: bool = False, most: int | None = None) -> DataFrame:
    """(word, ind, vec) of a file of words and components; row 0 is padding and row 1 the unknown word, which have no line.

    ``header``: the first line gives sizes.  Indexes follow file order: lines are
    numbered by their task first.  A word that comes twice is an error.
    """
    lines = spark.read.text(path).where(F.length("value") > 0)
    if header:
        lines = lines.where(F.size(F.split("value", " ")) > 2)
    # 31 bits of task, 33 bits of the line in it
    parts = lines.select(F.split("value", " ").alias("p"), F.monotonically_increasing_id().alias("at"))
    rows = parts.select(F.get("p", F.lit(0)).alias("word"), F.transform(F.slice("p", 2, F.size("p")), lambda x: x.cast("float")).alias("vec"), F.shiftright("at", 33).alias("task"), (F.col("at") % (1 << 33)).alias("line"))
    sizes = rows.groupBy("task").agg(F.count("*").alias("n"))  # a row for each task of the scan
    sizes = sizes.select("task", (F.sum("n").over(W.orderBy("task")) - F.col("n")).alias("before"))
    rows = rows.join(F.broadcast(sizes), "task").withColumn("n", F.col("before") + F.col("line"))
    if most is not None:
        rows = rows.where(F.col("n") < most - 1)
    twice = rows.groupBy("word").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['word']!r} comes more than once")
    return rows.select("word", (F.col("n") + 2).cast("int").alias("ind"), normalised("vec").alias("vec"))
