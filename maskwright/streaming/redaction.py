"""The stateless part of the engine as a stream: texts arrive, masked texts leave; scores come by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import evaluation


def masked_stream(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``text`` with every match of a pattern replaced by its type in brackets.

    Patterns apply in order of their types, each to what the former left; one pass
    over each row, without state, so it is the same for a table and for a stream.
    """
    text = F.col("text")
    for kind in sorted(patterns):
        text = F.regexp_replace(text, patterns[kind], f"[{kind}]")
    return docs.withColumn("text", text)


def scores_by_batch(system: DataFrame, docs: DataFrame, gold: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Scores of every micro-batch of system spans against the gold table, handed to ``sink`` with the batch's number."""

    def score(batch: DataFrame, number: int) -> None:
        own = docs.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        sink(evaluation.micro(evaluation.counts(own, gold, batch)), number)

    return system.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
