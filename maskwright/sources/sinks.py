"""Sinks: token CSV, prediction XML, reports, experiment folders."""

from __future__ import annotations

import datetime
import shutil
import socket
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.spans import numbered, tag_name


def with_sentinels(tokens: DataFrame) -> DataFrame:
    """Token rows of a document in order with ``<s>`` and ``</s>`` around each sentence: doc_id, ord, text, type, start, end."""
    ends = tokens.groupBy("doc_id", "sent_idx").agg(F.min(F.struct("tok_idx", "start", "end")).alias("a"), F.max(F.struct("tok_idx", "start", "end")).alias("z"))
    first = ends.select("doc_id", "sent_idx", F.lit(-1).alias("tok_idx"), F.lit("<s>").alias("text"), F.lit("O").alias("type"), F.col("a.start").alias("start"), F.col("a.start").alias("end"))
    last = ends.select("doc_id", "sent_idx", F.lit(1 << 30).alias("tok_idx"), F.lit("</s>").alias("text"), F.lit("O").alias("type"), F.col("z.start").alias("start"), F.col("z.end").alias("end"))
    rows = tokens.select("doc_id", "sent_idx", "tok_idx", "text", "type", "start", "end").unionByName(first).unionByName(last)
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("sent_idx", "tok_idx")) - 1).drop("sent_idx", "tok_idx")


def write_token_csv(tokens: DataFrame, path: str) -> None:
    """Token rows as CSV, a folder for each document."""
    rows = with_sentinels(tokens).repartition("doc_id").sortWithinPartitions("doc_id", "ord")
    rows.select("doc_id", "text", "type", "start", "end").write.partitionBy("doc_id").csv(path, header=True, quote='"', escape='"', mode="overwrite")


def escaped(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def prediction_tags(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, id (P0, P1, .. by start), tag_name, tag_type, start, end, text (the document's slice)."""
    cut = spans.select("doc_id", "tag_type", "start", "end").join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id")
    rows = cut.select("doc_id", "tag_type", "start", "end", F.expr("substring(doc_text, start + 1, end - start)").alias("text"))
    return numbered(rows).withColumn("tag_name", tag_name("tag_type"))


def tag_xml() -> Column:
    """One tag as an XML element, from id, tag_name, tag_type, start, end and text."""
    return F.concat(
        F.lit("<"), "tag_name", F.lit(' id="'), "id", F.lit('" start="'), F.col("start").cast("string"), F.lit('" end="'), F.col("end").cast("string"),
        F.lit('" text="'), escaped("text"), F.lit('" TYPE="'), "tag_type", F.lit('" comment=""/>'),
    )


def to_xml(docs: DataFrame, spans: DataFrame, root: str = "deIdi2b2", phi: bool = True) -> DataFrame:
    """(doc_id, xml): each document with its tags; documents without any have an empty list."""
    tags = prediction_tags(docs, spans)
    element = tag_xml()
    lists = tags.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", element.alias("e")))).alias("l"))
    joined = docs.select("doc_id", "text").join(lists, "doc_id", "left")
    body = F.array_join(F.transform(F.coalesce("l", F.array().cast("array<struct<start: int, end: int, e: string>>")), lambda x: x["e"]), "\n") if phi else F.lit("")
    text = F.replace("text", F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return joined.select("doc_id", F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8" ?>\n<{root}>\n<TEXT><![CDATA['), text, F.lit("]]></TEXT>\n<TAGS>\n"), body, F.lit(f"\n</TAGS>\n</{root}>\n")).alias("xml"))


def write_xml(xml: DataFrame, path: str) -> None:
    """One folder of text for each document."""
    xml.write.partitionBy("doc_id").mode("overwrite").text(path)


def report(summary: DataFrame) -> DataFrame:
    """A summary as lines for people: variant, measure, precision, recall, f1 to four places."""
    fmt = lambda c: F.format_string("%.4f", F.col(c))
    return summary.select("variant", fmt("precision").alias("precision"), fmt("recall").alias("recall"), fmt("f1").alias("f1"))


def experiment_directory(name: str, config_path: str, work_dir: str, postfix: str | None = None) -> Path:
    """A new folder named by experiment, host and time, with a copy of the configuration."""
    stamp = datetime.datetime.now().strftime("%Y-%m-%d-%H-%M-%S")
    path = Path(work_dir, "_".join(x for x in (name, socket.gethostname(), stamp, postfix) if x))
    path.mkdir(parents=True)
    shutil.copy(config_path, path / "config.yaml")
    return path
