"""Batches, splits and pairs for training; orders come from md5 of ids and the epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import pick

#: Rows are numbered in two steps over so many first digits of the order key (65,536 groups), so no task numbers all rows.
PREFIX = 4


def shuffled(key: str, epoch: int = 0) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{epoch}")))


def numbered(rows: DataFrame, order: Column, tie: str, name: str = "n") -> DataFrame:
    """``rows`` with their place (from 0) in the order of a hexadecimal key.

    Rows are counted and numbered within the key's first digits; what lies before
    each such group is a running sum over at most 65,536 rows.
    """
    own = rows.withColumn("_o", order).withColumn("_b", F.substring("_o", 1, PREFIX))
    own = own.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_o", tie)) - 1)
    sizes = rows.select(F.substring(order, 1, PREFIX).alias("_b")).groupBy("_b").agg(F.count("*").alias("_c"))
    sizes = sizes.withColumn("_before", F.sum("_c").over(W.orderBy("_b")) - F.col("_c")).drop("_c")
    return own.join(F.broadcast(sizes), "_b").withColumn(name, F.col("_before") + F.col("_r")).drop("_o", "_b", "_r", "_before")


def batches(rows: DataFrame, key: str, size: int, epoch: int = 0, keep_tail: bool = True) -> DataFrame:
    """``rows`` with ``batch`` and ``place`` (in the batch); the incomplete tail stays or goes."""
    out = numbered(rows, shuffled(key, epoch), key).withColumn("batch", F.floor(F.col("n") / size)).withColumn("place", F.col("n") % size)
    if keep_tail:
        return out.drop("n")
    total = rows.agg((F.floor(F.count("*") / size) * size).alias("whole"))  # one row
    return out.join(F.broadcast(total)).where("n < whole").drop("n", "whole")


def batches_with_features(rows: DataFrame, key: str, extra: DataFrame, size: int, epoch: int = 0) -> DataFrame:
    """``batches`` with the columns of ``extra`` (key and features), null where it has none; ``extra`` has a key once."""
    return batches(rows, key, size, epoch).join(extra, key, "left")


def compounding(start: float, stop: float, factor: float, n: int) -> list[int]:
    """Batch sizes that grow by ``factor`` up to ``stop``, truncated to integers."""
    return [int(min(start * factor**i, stop)) for i in range(n)]


def compounding_sizes(spark, start: float, stop: float, factor: float) -> DataFrame:
    """(batch, size, first): sizes up to the first that no longer grows, and how many rows come before each batch."""
    if not (start >= stop >= 1 or 0 < start < stop and stop >= 1 and factor > 1):
        raise ValueError("sizes must grow up to one row or more")
    n = 1
    while start * factor ** (n - 1) < stop:
        n += 1
    sizes = compounding(start, stop, factor, n)
    return spark.createDataFrame([(i, s, sum(sizes[:i])) for i, s in enumerate(sizes)], "batch int, size int, first long")


def growing_batches(rows: DataFrame, key: str, sizes: DataFrame, epoch: int = 0) -> DataFrame:
    """``rows`` with the batch their place falls into; the size of the last batch in ``sizes`` goes on without end."""
    own = numbered(rows, shuffled(key, epoch), key)
    last = sizes.agg(F.max("batch").alias("last"))  # one row
    known = sizes.join(F.broadcast(last)).withColumn("until", F.when(F.col("batch") < F.col("last"), F.col("first") + F.col("size")))
    after = F.col("n") - F.col("first")
    found = own.join(F.broadcast(known), (F.col("n") >= F.col("first")) & (F.col("until").isNull() | (F.col("n") < F.col("until"))))
    return found.select(*rows.columns, (F.col("batch") + F.floor(after / F.col("size"))).cast("int").alias("batch"), (after % F.col("size")).alias("place"))


def stratified_batches(rows: DataFrame, key: str, positive: Column, size: int, epoch: int = 0) -> DataFrame:
    """Batches half of which fulfil ``positive``; a half is half the size, rounded up, and the epoch ends with the smaller class."""
    half = -(-size // 2)
    marked = rows.withColumn("positive", F.coalesce(positive, F.lit(False)))
    both = numbered(marked.where("positive"), shuffled(key, epoch), key).unionByName(numbered(marked.where("not positive"), shuffled(key, epoch), key))
    least = marked.agg(F.least(F.sum(F.col("positive").cast("long")), F.sum((~F.col("positive")).cast("long"))).alias("least"))  # one row
    return both.join(F.broadcast(least)).where("n < least").withColumn("batch", F.floor(F.col("n") / half)).drop("n", "least")


def split_train_validation(rows: DataFrame, key: str, fraction: float, validation: float, total: int | None = None, salt: int = 0) -> DataFrame:
    """``rows`` of the drawn share with ``split``: at least one row for validation, the rest for training.

    ``size = min(max(int(fraction * total), 2), total)`` rows are drawn by hash; ``validation`` of them, at least one, validate.
    """
    total = rows.count() if total is None else total
    size = min(max(int(fraction * total), 2), total)
    valid = max(1, int(validation * size))
    own = numbered(rows, shuffled(key, salt), key).where(F.col("n") < size)
    return own.withColumn("split", F.when(F.col("n") < valid, "validation").otherwise("train")).drop("n")


def chosen_alternative(alternatives: DataFrame, epoch: int = 0, include_original: bool = True) -> DataFrame:
    """(id, alt): which alternative of each row an epoch takes; -1 is the original, taken if there is no alternative."""
    n = F.col("n_alternatives") + (1 if include_original else 0)
    return alternatives.select("id", F.when(n > 0, pick(n, F.col("id"), F.lit(epoch)) - (1 if include_original else 0)).otherwise(-1).cast("int").alias("alt"))


def real_fake_pairs(sentences: DataFrame, alternatives: DataFrame, salt: str = "0") -> DataFrame:
    """(id, left, right, same): every sentence with itself (1) and with a picked alternative of its own (0).

    ``alternatives``: id, alt, text; sentences without alternatives are left out.
    """
    n = alternatives.groupBy("id").agg(F.count("*").alias("n"))
    rows = sentences.select("id", F.col("text").alias("real")).join(n, "id").withColumn("alt", pick(F.col("n"), F.col("id"), F.lit(salt)).cast("int"))
    rows = rows.join(alternatives.select("id", "alt", F.col("text").alias("fake")), ["id", "alt"])
    pairs = F.array(F.struct(F.col("real").alias("left"), F.col("real").alias("right"), F.lit(1).alias("same")), F.struct(F.col("real").alias("left"), F.col("fake").alias("right"), F.lit(0).alias("same")))
    return rows.select("id", F.explode(pairs).alias("p")).select("id", "p.*")


def real_fake_singles(sentences: DataFrame, alternatives: DataFrame, salt: str = "0") -> DataFrame:
    """(id, text, real): every sentence (1) and its picked alternative (0)."""
    return real_fake_pairs(sentences, alternatives, salt).select("id", F.col("right").alias("text"), F.col("same").alias("real"))


def augmented_triples(sentences: DataFrame, augmented: DataFrame, fake: DataFrame, salt: str = "0") -> DataFrame:
    """(id, left, right, same): the first augmented form with the sentence (1) and with a picked fake one (0)."""
    n = fake.groupBy("id").agg(F.count("*").alias("n"))
    first = augmented.where("alt = 0").select("id", F.col("text").alias("left"))
    rows = sentences.select("id", F.col("text").alias("real")).join(first, "id").join(n, "id")
    rows = rows.withColumn("alt", pick(F.col("n"), F.col("id"), F.lit(salt)).cast("int")).join(fake.select("id", "alt", F.col("text").alias("fake")), ["id", "alt"])
    pairs = F.array(F.struct(F.col("real").alias("right"), F.lit(1).alias("same")), F.struct(F.col("fake").alias("right"), F.lit(0).alias("same")))
    return rows.select("id", "left", F.explode(pairs).alias("p")).select("id", "left", "p.*")


def with_augmented(rows: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Original and augmented rows: id, alt (-1: original), text, label; labels are repeated."""
    original = rows.select("id", F.lit(-1).alias("alt"), "text", "label")
    return original.unionByName(alternatives.select("id", "alt", "text").join(rows.select("id", "label"), "id").select("id", "alt", "text", "label"))


def sampled_words(vocab: DataFrame, known: DataFrame, n: int = 1000, salt: str = "0") -> DataFrame:
    """``n`` words longer than two characters, without digits, that ``known`` (word) has."""
    rows = vocab.where((F.length("word") > 2) & ~F.col("word").rlike("[0-9]")).join(known.select("word"), "word", "left_semi")
    return rows.select("word").distinct().orderBy(F.md5(F.concat_ws("|", "word", F.lit(salt))), "word").limit(n)


def limited_documents(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Rows of the first ``n`` documents by id; ids are picked before anything is read in full."""
    return rows.join(F.broadcast(rows.select(key).distinct().orderBy(key).limit(n)), key, "left_semi")


# --- generators of several streams ----------------------------------------------------------------


def with_batch(members: DataFrame, rows: DataFrame, key: str, size: int, epoch: int = 0) -> DataFrame:
    """``members`` (id and any columns, several rows an id) with ``batch`` and ``place`` of their row in the epoch.

    Joined by id, which is spread evenly, and not by batch.
    """
    placed = batches(rows.select(key), key, size, epoch).select(F.col(key).alias("id"), "batch", "place")
    return members.join(placed, "id")


def adversary_batches(rows: DataFrame, key: str, size: int, sentences: DataFrame, alternatives: DataFrame, epoch: int = 0, pairs=real_fake_pairs, **more: DataFrame) -> DataFrame:
    """``pairs`` (pairs, singles or triples of real and fake) in the batches that an epoch of ``rows`` has; the pick changes with the epoch."""
    return with_batch(pairs(sentences, alternatives, **more, salt=str(epoch)), rows, key, size, epoch)


def combined_batches(rows: DataFrame, key: str, extra: DataFrame, size: int, sentences: DataFrame, alternatives: DataFrame, epoch: int = 0) -> DataFrame:
    """Both inputs of every batch: rows with their features (``side`` main), and the pairs made of the same rows (``side`` pair).

    batch, place, side, id, left, right, same, and the columns of ``extra`` (key and features); what a side lacks is null.
    """
    main = batches_with_features(rows.select(key), key, extra, size, epoch).withColumnRenamed(key, "id").withColumn("side", F.lit("main"))
    pair = adversary_batches(rows, key, size, sentences, alternatives, epoch).withColumn("side", F.lit("pair"))
    return main.unionByName(pair, allowMissingColumns=True)


def alternating_steps(*streams: DataFrame) -> DataFrame:
    """Batches of several streams in turn: ``step`` and ``stream`` (from 0); the epoch ends with the shortest stream.

    A row's step follows from its own batch number, so the streams are not joined.  They have the same columns but for those that are null elsewhere.
    """
    k = len(streams)
    lengths = [s.agg((F.coalesce(F.max("batch"), F.lit(-1)) + 1).alias("n")) for s in streams]  # one row each
    least = lengths[0]
    for more in lengths[1:]:
        least = least.unionByName(more)
    least = least.agg(F.min("n").alias("_least"))
    out = None
    for i, stream in enumerate(streams):
        own = stream.withColumn("stream", F.lit(i)).withColumn("step", F.col("batch") * k + i)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.join(F.broadcast(least)).where(F.col("batch") < F.col("_least")).drop("_least")
