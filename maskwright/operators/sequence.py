"""Linear chains over label sequences: likelihood, marginals and best paths as folds over array columns.

A sentence is one row with ``unary``, an array of scores by label for each of its
tokens, and ``labels``, their label numbers from 0.  ``transitions`` is an array column
(or literal) of scores from label to label.  Everything is in log space and stays in
the JVM; a fold keeps one array of scores a token, so a row must be a sentence, not a
text without bounds.  For whole tables ``tallies``, ``counted`` and ``likelihoods`` count a chain
and score its sentences in Arrow batches.

Defined cases: an empty sentence has log likelihood 0 and no marginals; a null label is
an error where its score is read; ties of the best path go to the smaller label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from ..storage import ship, stored

#: What makes batches of sentences of batches of rows.
Cut = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def matrix(rows: list[list[float]]) -> Column:
    """A literal of scores by label and label."""
    return F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in rows))


def transposed(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))


def log_sum_exp(scores: Column) -> Column:
    """log of the sum of exponentials, from the largest, so nothing overflows."""

    def summed(s: Column) -> Column:
        most = F.array_max(s)
        return most + F.log(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - most)))

    return bound(scores, summed)


def _step(before: Column, into: Column, unary: Column) -> Column:
    """Scores by label one token on; ``into`` has, for each label, the transitions that lead to it."""
    return F.zip_with(into, unary, lambda column, u: u + log_sum_exp(F.zip_with(before, column, lambda a, t: a + t)))


def _rest(unary: Column) -> Column:
    return F.slice(unary, F.lit(2), F.greatest(F.size(unary) - 1, F.lit(0)))


def log_partition(unary: Column, transitions: Column) -> Column:
    """log of the sum over all label sequences of exp(score)."""

    def of(u: Column) -> Column:
        return bound(transposed(transitions), lambda into: log_sum_exp(F.aggregate(_rest(u), F.get(u, F.lit(0)), lambda acc, x: _step(acc, into, x))))

    return F.when(F.size(unary) > 0, bound(unary, of)).otherwise(F.lit(0.0))


def sequence_score(unary: Column, transitions: Column, labels: Column) -> Column:
    """Score of one label sequence: its tokens' scores and the transitions between neighbours."""
    own = F.aggregate(F.zip_with(unary, labels, lambda u, y: F.element_at(u, y + 1)), F.lit(0.0), lambda acc, x: acc + x)
    before = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))
    steps = F.aggregate(F.zip_with(before, _rest(labels), lambda a, b: F.element_at(F.element_at(transitions, a + 1), b + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(labels) > 0, own + steps).otherwise(F.lit(0.0))


def log_likelihood(unary: Column, transitions: Column, labels: Column) -> Column:
    """log P(labels | sentence) of the chain."""
    return sequence_score(unary, transitions, labels) - log_partition(unary, transitions)


def _running(unary: Column, into: Column) -> Column:
    """Scores of all beginnings by token and label."""
    first = F.array(F.get(unary, F.lit(0)))
    return F.aggregate(_rest(unary), first, lambda acc, x: F.concat(acc, F.array(_step(F.element_at(acc, -1), into, x))))


def marginals(unary: Column, transitions: Column) -> Column:
    """P(label | sentence) by token and label: beginnings forwards, ends backwards."""

    def both(u: Column) -> Column:
        forward = _running(u, transposed(transitions))
        # backwards, what is behind a token counts the token itself too; it is taken off once
        backward = F.reverse(_running(F.reverse(u), transitions))
        total = log_partition(u, transitions)
        return bound(
            F.struct(forward.alias("f"), backward.alias("b"), total.alias("z")),
            lambda s: F.transform(F.arrays_zip(s["f"].alias("f"), s["b"].alias("b"), u.alias("u")), lambda t: F.transform(F.arrays_zip(t["f"].alias("f"), t["b"].alias("b"), t["u"].alias("u")), lambda x: F.exp(x["f"] + x["b"] - x["u"] - s["z"]))),
        )

    return F.when(F.size(unary) > 0, bound(unary, both)).otherwise(F.array().cast("array<array<double>>"))


def best_path(unary: Column, transitions: Column) -> Column:
    """The label sequence of highest score (Viterbi): each label keeps its best beginning as a path of labels."""

    def of(u: Column) -> Column:
        def start(scores: Column) -> Column:
            return F.transform(scores, lambda s, j: F.struct(s.alias("score"), F.array(j).alias("path")))

        def step(acc: Column, scores: Column, into: Column) -> Column:
            def arrive(column: Column, s: Column, j: Column) -> Column:
                ways = F.transform(column, lambda t, i: F.struct((F.get(acc, i)["score"] + t).alias("score"), (-i).alias("from")))
                return bound(F.array_max(ways), lambda w: F.struct((w["score"] + s).alias("score"), F.concat(F.get(acc, -w["from"])["path"], F.array(j)).alias("path")))

            return F.transform(F.arrays_zip(into.alias("c"), scores.alias("s")), lambda x, j: arrive(x["c"], x["s"], j))

        last = bound(transposed(transitions), lambda into: F.aggregate(_rest(u), start(F.get(u, F.lit(0))), lambda acc, x: step(acc, x, into)))
        return bound(last, lambda ends: F.get(ends, -F.array_max(F.transform(ends, lambda e, j: F.struct(e["score"].alias("score"), (-j).alias("j"))))["j"])["path"])

    return F.when(F.size(unary) > 0, bound(unary, of)).otherwise(F.array().cast("array<int>"))


# --- chains of counts over whole tables -----------------------------------------------------------


@dataclass
class Chain:
    """Scores of a chain that were counted: ``counts`` (word, before, counts), ``totals`` by label, ``steps`` from label to label."""

    counts: DataFrame
    totals: np.ndarray
    steps: np.ndarray


def _unary(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Scores by label of words with these counts; a word never seen has counts of 0."""
    return np.log((counts + 1) / (totals + 1))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """How many words each sentence has, all words and their label numbers, 0 if sentences come without ``labels``."""
    words = batch.column("words")
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten().cast(pa.string())
    if "labels" not in batch.schema.names:
        return sizes, flat, np.zeros(len(flat), np.int64)
    labels = batch.column("labels").flatten()
    if labels.null_count or len(labels) != len(flat):
        raise ValueError("every word must have a label")
    return sizes, flat, labels.to_numpy(zero_copy_only=False).astype(np.int64)


def _heads(sizes: np.ndarray) -> np.ndarray:
    """Whether a word is the first of its sentence."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    heads = np.zeros(starts[-1], bool)
    heads[starts[:-1][sizes > 0]] = True
    return heads


def tallies(sentences: DataFrame, n_labels: int, cut: Cut | None = None) -> DataFrame:
    """Parts of what ``counted`` adds up, some of each Arrow batch: word, before, label, n.

    ``sentences`` have ``words`` and, unless all are label 0, ``labels``.  With ``cut`` they are made
    of the given rows' batches in the same task.  ``before`` is -1 for words; for steps it is the label before, and the word is null.
    """
    ship(sentences.sparkSession)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches) if cut else batches:
            sizes, words, labels = _flat(batch)
            inner = np.flatnonzero(~_heads(sizes))
            steps = np.bincount(labels[inner - 1] * n_labels + labels[inner], minlength=n_labels**2)
            for y in np.unique(labels).tolist():
                n = (words if (labels == y).all() else words.filter(pa.array(labels == y))).value_counts()
                yield pa.RecordBatch.from_arrays([n.field(0), pa.array(np.full(len(n), -1, np.int32)), pa.array(np.full(len(n), y, np.int32)), n.field(1)], ["word", "before", "label", "n"])
            a, b = np.divmod(np.arange(n_labels**2, dtype=np.int32), n_labels)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.string()), pa.array(a), pa.array(b), pa.array(steps.astype(np.int64))], ["word", "before", "label", "n"])

    return sentences.mapInArrow(tally, "word string, before int, label int, n long")


def counted(parts: DataFrame, n_labels: int) -> Chain:
    """The chain whose scores of words are log((n(word, b) + 1) / (n(b) + 1)) and of steps log((n(a, b) + 1) / (n(a) + labels))."""
    of = [F.sum(F.when(F.col("label") == b, F.col("n")).otherwise(0)) for b in range(n_labels)]
    counts = stored(parts.groupBy("word", "before").agg(F.array(*of).alias("counts")), "counts")
    each = counts.select("before", *(F.get("counts", F.lit(b)).alias(f"n{b}") for b in range(n_labels)))
    sums = each.groupBy("before").agg(*(F.sum(f"n{b}").alias(f"n{b}") for b in range(n_labels))).collect()  # a label a row, and one for words
    table = np.zeros((n_labels + 1, n_labels), np.int64)
    for r in sums:
        table[r["before"] + 1] = r[1:]
    return Chain(counts, table[0], np.log((table[1:] + 1) / (table[1:].sum(1, keepdims=True) + n_labels)))


#: Frequent words, so many at most, whose scores every task has; the counts above a limit, all or none of one count.
HEAD_WORDS = 1 << 17


def frequent_words(chain: Chain, most: int = HEAD_WORDS) -> tuple[pa.Array, np.ndarray]:
    """Words of the highest counts and their scores by label, with a last row of scores for a word never seen."""
    words = chain.counts.where("before = -1 and word is not null").withColumn("n", F.aggregate("counts", F.lit(0).cast("long"), lambda acc, x: acc + x))
    taken, least = 0, None
    for r in words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():  # different counts are few: n of them add up to n * n / 2 tokens at least
        taken += r["words"]
        if taken > most:
            break
        least = r["n"]
    k = len(chain.totals)
    found = words.where(F.col("n") >= least if least is not None else F.lit(False)).select("word", "counts").toArrow()  # ``most`` at most
    counts = found.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return found.column("word").combine_chunks().cast(pa.string()), _unary(np.vstack([counts, np.zeros((1, k), np.int64)]), chain.totals)


def log_likelihoods(unary: np.ndarray, sizes: np.ndarray, labels: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """``log_likelihood`` of many sentences at once: ``unary`` and ``labels`` of their words one after another, ``sizes`` of the sentences."""
    many, k = len(sizes), len(steps)
    own = unary[np.arange(len(labels)), labels]
    inner = np.flatnonzero(~_heads(sizes))
    own[inner] += steps[labels[inner - 1], labels[inner]]
    order = np.argsort(-sizes, kind="stable")  # the longest first, so those that still go on are the first ones
    starts = (np.cumsum(sizes) - sizes)[order]
    going = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    sums = np.zeros((k, many))  # over all beginnings that end in a label
    for i, m in enumerate(going.tolist()):
        here = unary[starts[:m] + i].T
        if i:
            ways = sums[:, None, :m] + steps[:, :, None]
            top = ways.max(0)
            here = here + top + np.log(np.exp(ways - top).sum(0))
        sums[:, :m] = here
    top = sums.max(0)
    total = np.empty(many)
    total[order] = top + np.log(np.exp(sums - top).sum(0))
    return np.where(sizes > 0, np.bincount(np.repeat(np.arange(many), sizes), own, many) - total, 0.0)


#: Of sentences that wait: for each word its number times the number of labels plus its label, or the label less the number of labels, and the words without number.
_PENDING = {"codes": "array<int>", "rest": "array<string>"}


def likelihoods(chain: Chain, *sources: tuple[DataFrame, Cut | None], most: int = HEAD_WORDS) -> DataFrame:
    """doc_id, sent_idx, n_tokens, log_likelihood of all sentences of ``sources``, each as ``tallies`` takes them.

    Sentences of frequent words alone are done where they are cut.  Of the others, only the words that are
    not frequent are exchanged, so no word is in many of the rows, and looked up in the counts;
    the sentences wait as numbers of words.
    """
    spark = chain.counts.sparkSession
    shared = spark.sparkContext.broadcast((*frequent_words(chain, most), chain.steps))  # ``most`` words
    passed = reduce(DataFrame.unionByName, [_passed(sentences, cut, shared) for sentences, cut in sources])
    passed = stored(passed.withColumn("id", F.monotonically_increasing_id()), "passed")
    result, totals = ["doc_id", "sent_idx", "n_tokens", "log_likelihood"], chain.totals

    pending = passed.where("codes is not null")
    zero = F.array_repeat(F.lit(0).cast("long"), len(chain.totals))
    known = chain.counts.where("before = -1").select("word", "counts")
    rest = pending.select("id", F.posexplode("rest").alias("k", "word")).join(known, "word", "left").select("id", F.struct("k", F.coalesce("counts", zero).alias("counts")).alias("w"))
    found = rest.groupBy("id").agg(F.array_sort(F.collect_list("w")).alias("w"))  # a sentence is bounded
    both = pending.join(found.select("id", F.flatten(F.transform("w", lambda x: x["counts"])).alias("counts")), "id")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unary, steps = shared.value
        for batch in batches:
            codes, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("codes", "counts"))
            words, labels = np.divmod(codes, len(steps))
            own = unary[words]
            own[words == -1] = _unary(counts.reshape(-1, len(steps)), totals)
            sizes = batch.column("codes").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in result[:3]), pa.array(log_likelihoods(own, sizes, labels, steps))], result)

    done = passed.where("codes is null").select(*result)
    schema = ", ".join(f"{c} {t}" for c, t in done.dtypes)
    return done.unionByName(both.select(*result[:3], "codes", "counts").mapInArrow(finish, schema))


def _passed(sentences: DataFrame, cut: Cut | None, shared: Broadcast) -> DataFrame:
    """Sentences with their likelihood, or, where words are not frequent, with numbers of words and those words."""
    ship(sentences.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unary, steps = shared.value
        for batch in cut(batches) if cut else batches:
            sizes, words, labels = _flat(batch)
            codes = pc.index_in(words, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
            codes[words.is_null().to_numpy(zero_copy_only=False)] = len(names)
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            waits = np.bincount(sentence[codes == -1], minlength=len(sizes)) > 0
            for waiting in (False, True):
                at = np.flatnonzero(waits == waiting)
                if not len(at):
                    continue
                mine = np.flatnonzero(waits[sentence] == waiting)
                own, y = codes[mine], labels[mine]
                arrays = [*(batch.column(c).take(pa.array(at)) for c in ("doc_id", "sent_idx")), pa.array(sizes[at])]
                if waiting:
                    rest = own == -1
                    lists = [(sizes[at], pa.array((own * len(steps) + y).astype(np.int32))), (np.bincount(sentence[mine][rest], minlength=len(sizes))[at], words.take(pa.array(mine[rest])))]
                    arrays += [pa.nulls(len(at), pa.float64()), *(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), x) for n, x in lists)]
                else:
                    arrays += [pa.array(log_likelihoods(unary[own], sizes[at], y, steps)), *(pa.nulls(len(at), pa.list_(t)) for t in (pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "sent_idx", "n_tokens", "log_likelihood", *_PENDING])

    kept = ", ".join(f"{c} {t}" for c, t in sentences.select("doc_id").dtypes)
    return sentences.mapInArrow(score, f"{kept}, sent_idx int, n_tokens long, log_likelihood double, " + ", ".join(f"{c} {t}" for c, t in _PENDING.items()))
