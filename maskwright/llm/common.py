"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
_ARCHIVE = "maskwright_workers.zip"
_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only in local mode (tests), where all share one machine, may that setting be absent; then a temporary folder is used.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="maskwright-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _scratch:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


_held: dict[str, Any] = {}


def worker_memory(name: str, make: Callable[[], Any]) -> Any:
    """What this Python worker remembers under ``name`` from task to task.

    A worker holds one such thing: what it remembered under another name goes
    first, so the stages of a long job don't add up.
    """
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def give_back() -> None:
    """Hand freed memory back to the machine, which allocators else keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def stored(df: DataFrame, name: str, group_bytes: int = 128 << 20) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in row groups of ``group_bytes``, and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("parquet.block.size", group_bytes).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def least_tasks(spark: SparkSession) -> int:
    """Tasks that small results are brought to at least: a task then sorts in 12 shuffle partitions at most, each of which holds memory to its end."""
    return max(6, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 12))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, rather than whenever the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _ship(spark: SparkSession) -> None:
    """Let Spark hand this package to the executors, once for each context."""
    context = spark.sparkContext
    if any(Path(p).name == _ARCHIVE for p in context._python_includes):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="maskwright-")) / _ARCHIVE  # the driver serves it from here
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))


def bounded_batches(spark: SparkSession) -> None:
    """Make ready for Python workers: they get this package, and Arrow batches small enough for very long texts."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty; other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def remainder(column: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; -1 for a null id."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % mod, F.lit(-1))


class WordHashes(dict):
    """word -> unsigned 64-bit hash, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 400_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def array(self, words: list[str] | list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (splitmix finaliser)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def in_portions(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add to ``most`` or that have one member."""
    start = total = end = 0
    for end, size in enumerate(sizes, 1):
        if end - 1 > start and total + size > most:
            yield start, end - 1
            start, total = end - 1, 0
        total += size
    if end > start:
        yield start, end


def ascii_words(text: str) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of ``text`` with A-Z in lower case, as UTF-8: just what bytes know of cases and spaces."""
    return text.encode().lower().split()


def most_frequent(counted: DataFrame, most: int, least: int = 1) -> DataFrame:
    """The rows of ``counted`` with the largest ``n``, ``least`` or more: whole levels of n, as many as come to at most ``most`` rows.

    No rows are sorted, and only a histogram of n goes to the driver: exact counts up to 65,536 and powers of two beyond.
    """
    level = F.when(F.col("n") < 65536, F.col("n")).otherwise(F.lit(65536) + F.floor(F.log2("n")))
    sizes = counted.where(F.col("n") >= least).groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).orderBy(F.desc("level")).collect()
    total, bound = 0, 1 << 62
    for r in sizes:
        total += r["rows"]
        if total > most:
            break
        bound = r["n"]
    return counted.where(F.col("n") >= bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, keep: Column, bound: int) -> DataFrame:
    """Texts and 0/1 labels of at most ``bound`` labelled documents (doc_id, text, label).

    ``keep`` says which doc_ids may be learned from.  The smallest hashes of
    doc_id are taken; a document with several labels counts as its largest.  Of
    rows with one doc_id that with the least text hash counts, so the bound is one of rows.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    found = texts_of(docs).join(F.broadcast(picked), "doc_id")  # at most `bound` rows of 12 bytes
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r"))
    return one.select("doc_id", "r.text", "r.label")
