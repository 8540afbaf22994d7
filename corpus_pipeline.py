"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All stages but the last
return the columns of ``documents``:

1. quality: documents that the classifier rejects go;
2. near_duplicates: one document of each group of similar ones stays (five-word
   shingles, Jaccard 0.8 or more);
3. decontaminate: documents that hold a benchmark item go;
4. secrets: secrets in texts are replaced by a mark, all documents stay;
5. packing: documents become pieces of at most 2048 tokens with their place in a
   training sequence.

Extra columns of documents are kept up to the last stage.  Null texts pass: they
have no secrets and no shingles, and pack as an empty document.  An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import decontamination, packing, parity_join, quality, secret_scan
from maskwright.llm.common import remainder, stored


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from this stage's own documents and their labels; held-out labels are not used."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 4) != 2)
    return quality.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group stays."""
    return parity_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without secrets; ``n_chars`` follows the text."""
    return secret_scan.redact(docs, secret_scan.word_ranks(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL has no classifier and no packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
