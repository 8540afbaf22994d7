"""Generators of several streams, lookups of frequent words, and run histories."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import lookup, sampling
from maskwright.sources.history import RunHistory
from maskwright.storage import fresh_path


def sentences(spark, n):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(n)], "id long, text string")
    alternatives = spark.createDataFrame([(i, a, f"fake {i} {a}") for i in range(0, n, 2) for a in range(1 + i % 3)], "id long, alt int, text string")
    return docs, alternatives


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_combined_batches(spark, n):
    docs, alternatives = sentences(spark, n)
    extra = docs.select("id", (F.col("id") * 2).alias("feature"))
    for epoch in (0, 1):
        rows = sampling.combined_batches(docs, "id", extra, 8, docs, alternatives, epoch).collect()
        main = {r["id"]: r for r in rows if r["side"] == "main"}
        pairs = [r for r in rows if r["side"] == "pair"]
        assert sorted(main) == list(range(n)) and len(main) == sum(r["side"] == "main" for r in rows)
        assert all(r["feature"] == 2 * i and r["same"] is None for i, r in main.items())
        assert sorted((r["batch"], r["place"]) for r in main.values()) == [(i // 8, i % 8) for i in range(n)]
        assert sorted((r["id"], r["same"]) for r in pairs) == [(i, s) for i in range(0, n, 2) for s in (0, 1)]
        assert all(r["batch"] == main[r["id"]]["batch"] and r["left"] == f"text {r['id']}" and (r["right"] == r["left"]) == bool(r["same"]) for r in pairs)


def test_batches_of_triples_and_singles(spark):
    docs, alternatives = sentences(spark, 40)
    triples = sampling.adversary_batches(docs, "id", 8, docs, alternatives, 0, sampling.augmented_triples, fake=alternatives).collect()
    singles = sampling.adversary_batches(docs, "id", 8, docs, alternatives, 0, sampling.real_fake_singles).collect()
    placed = {r["id"]: (r["batch"], r["place"]) for r in sampling.batches(docs, "id", 8).collect()}
    assert len(triples) == len(singles) == 40
    assert all((r["batch"], r["place"]) == placed[r["id"]] for r in triples + singles)


def test_alternating_steps(spark):
    docs, _ = sentences(spark, 50)
    long, short = sampling.batches(docs.select("id"), "id", 5), sampling.batches(docs.where("id < 21").select("id"), "id", 10, epoch=3)
    rows = sampling.alternating_steps(long, short).collect()
    assert sorted({(r["step"], r["stream"]) for r in rows}) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0), (5, 1)]
    assert len([r for r in rows if r["stream"] == 0]) == 15 and sorted(r["id"] for r in rows if r["stream"] == 1) == list(range(21))
    assert sampling.alternating_steps(long, short.where("false")).count() == 0
    plan = sampling.alternating_steps(long, short)._jdf.queryExecution().optimizedPlan().toString()
    assert "batch" not in "".join(line for line in plan.splitlines() if "Join Inner" in line and "= batch" in line)


def source(spark, words, value):
    return spark.createDataFrame([(w, [float(value), float(len(w))]) for w in words], "word string, vec array<double>")


def test_lookup_of_frequent_words(spark):
    words = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "the").otherwise(F.concat(F.lit("w"), (F.col("id") % 500).cast("string"))).alias("word"))
    vocabulary = ["the", *(f"w{i}" for i in range(500))]
    cache, every = source(spark, vocabulary[:100], 1), source(spark, vocabulary, 2)
    found = lookup.resolved(words, cache, every)
    assert found.count() == words.select("word").distinct().count()
    for head in (1 << 20, 0):
        got = lookup.attached(words, found, head).collect()
        assert len(got) == 20_000 and all(r["vec"] == [1.0 if r["word"] in vocabulary[:100] else 2.0, float(len(r["word"]))] and r["source"] == int(r["word"] not in vocabulary[:100]) for r in got)
    # frequent words are not exchanged: the tail alone is
    rows = lookup.attached(words, found)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_unknown_words_are_an_error(spark):
    words = spark.createDataFrame([("a",), ("b",), (None,)], "word string")
    with pytest.raises(Exception, match="no vector for b"):
        lookup.resolved(words, source(spark, ["a"], 1)).collect()


def test_saved_cache_is_not_exchanged(spark):
    words = spark.createDataFrame([(f"w{i % 50}",) for i in range(400)], "word string")
    found = lookup.resolved(words, source(spark, [f"w{i}" for i in range(50)], 1))
    path = fresh_path(spark, "vectors")
    lookup.save_cache(found, "saved_vectors", path, 8)
    try:
        cache = lookup.saved_cache(spark, "saved_vectors")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = words.repartition(8, "word").join(cache, "word")
        assert joined.count() == 400
        plan = words.repartition(8, "word").join(cache, "word")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS saved_vectors")


def test_history_survives_death(spark):
    history = RunHistory(spark, fresh_path(spark, "history"), "loss double, epoch long")
    made = []

    def step(k):
        made.append(k)
        if k == 2 and made.count(2) == 1:
            raise RuntimeError("died before writing")
        return spark.createDataFrame([(1.0 / (k + 1), k)], "loss double, epoch long") if k != 3 else spark.createDataFrame([], "loss double, epoch long")

    assert history.next_step() == 0 and history.rows().count() == 0
    with pytest.raises(RuntimeError):
        history.run(5, step)
    assert history.next_step() == 2
    # written, but never committed
    history.write(2, spark.createDataFrame([(9.0, 2)], "loss double, epoch long"))
    assert history.rows().count() == 2
    again = RunHistory(spark, history.path, history.schema)
    assert again.run(5, step) == 3 and again.run(5, step) == 0
    assert made == [0, 1, 2, 2, 3, 4]
    assert sorted((r["step"], r["epoch"], r["loss"]) for r in again.rows().collect()) == [(0, 0, 1.0), (1, 1, 0.5), (2, 2, 1 / 3), (4, 4, 0.2)]
    with pytest.raises(Exception, match="committed already"):
        again.commit(4, "steps/other")
