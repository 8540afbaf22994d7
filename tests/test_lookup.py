import pytest
from pyspark.sql import functions as F

from maskwright import environment
from maskwright.operators import evaluation, labels, lookup, sampling


def test_word_vectors(spark):
    words = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "word string, n int")
    cache = spark.createDataFrame([("a", [9.0])], "word string, vec array<double>")
    full = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "word string, vec array<double>")
    got = {r["n"]: (r["vec"], r["source"]) for r in lookup.word_vectors(words, cache, full).collect()}
    assert got == {1: ([9.0], 0), 2: ([2.0], 1), 3: ([9.0], 0)}
    assert lookup.word_vectors(words.limit(0), cache).count() == 0
    assert sorted(r["word"] for r in lookup.vector_cache(words, full).collect()) == ["a", "b"]
    for bad in ("z", None):
        with pytest.raises(Exception, match="no vector for"):
            lookup.word_vectors(spark.createDataFrame([(bad,)], "word string"), cache, full).collect()


def test_sentences(spark):
    full = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "word string, vec array<double>")
    tokens = spark.createDataFrame([(1, 0, k, w) for k, w in enumerate("abba")], "doc_id long, sent_idx int, tok_idx int, word string")
    assert lookup.sentence_matrix(tokens, full).first()["matrix"] == [[1.0], [2.0], [2.0], [1.0]]
    cache = spark.createDataFrame([("a b", 7), ("", 8), ("n", None)], "sentence string, value int")
    rows = spark.createDataFrame([(0, ["a", "b"]), (1, ["a b"]), (2, []), (3, ["n"])], "k int, words array<string>")
    assert {r["k"]: r["value"] for r in lookup.cached_sentences(rows, cache).collect()} == {0: 7, 1: 7, 2: 8, 3: None}
    with pytest.raises(Exception, match="no entry for b"):
        lookup.cached_sentences(spark.createDataFrame([(["b"],)], "words array<string>"), cache).collect()


def test_jitter_gives_zero_vectors_a_direction(spark):
    rows = spark.createDataFrame([([0.0, 0.0],), ([1.0, 0.0],)], "vec array<double>")
    zero, other = (r[0] for r in rows.select(lookup.jittered("vec", 1)).collect())
    assert any(zero) and max(map(abs, zero)) < 1e-4 and other == [1.0, 0.0]


def test_padding_and_chunks(spark):
    rows = spark.createDataFrame([(0, list("abc")), (1, []), (2, ["x"])], "k int, words array<string>")
    out = {r["k"]: r for r in lookup.padded(rows).withColumn("back", lookup.unpadded()).collect()}
    assert out[1]["padded"] == ["", "", ""] and out[2]["padded"] == ["x", "", ""] and [out[k]["n_words"] for k in range(3)] == [3, 0, 1]
    assert [out[k]["back"] for k in range(3)] == [list("abc"), [], ["x"]]
    parts = sorted((r["k"], r["chunk"], r["words"]) for r in lookup.chunked(rows, 2).collect())
    assert parts == [(0, 0, ["a", "b"]), (0, 1, ["c"]), (2, 0, ["x"])]
    assert lookup.padded(rows.limit(0)).count() == 0 == lookup.chunked(rows.limit(0), 2).count()


def test_unpadded_matrix(spark):
    rows = spark.createDataFrame([([[0.0, 0.0], [0.0, 1.0], [2.0, 0.0]], [5, 6, 7]), ([[0.0]], [1])], "m array<array<double>>, p array<int>")
    m, p = lookup.unpadded_matrix("m", "p")
    assert [tuple(r) for r in rows.select(m, p).collect()] == [([[0.0, 1.0], [2.0, 0.0]], [6, 7]), ([], [])]


def test_statistics():
    assert lookup.statistics("fasttext").std == 0.05
    with pytest.raises(ValueError, match="unknown kind"):
        lookup.statistics("other")


def test_subsequences_and_places(spark):
    unit = "doc_id string, start int, end int"
    outer = spark.createDataFrame([("1", 0, 2), ("1", 3, 5), ("1", 3, 5)], unit)
    inner = spark.createDataFrame([("1", 3, 5), ("2", 0, 1)], unit)
    assert {r["doc_id"]: r["subsequence"] for r in evaluation.subsequences(inner, outer, "doc_id").collect()} == {"1": True, "2": False}
    docs = spark.createDataFrame([("1", "ab cd ef")], "doc_id string, text string")
    spans = spark.createDataFrame([("1", "DATE", "DATE", 3, 8, "cd ef"), ("1", "AGE", "AGE", 4, 5, "d")], "doc_id string, tag_type string, tag_name string, start int, end int, text string")
    got = sorted((r["tag_type"], r["start"], r["place"]) for r in evaluation.token_places(docs, spans).collect())
    assert got == [("AGE", 4, None), ("DATE", 3, 1), ("DATE", 6, 2)]


def test_sizes_and_features(spark):
    tokens = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 0)], "doc_id long, sent_idx int")
    assert tuple(labels.sentence_sizes(tokens).first()) == (2, 3, 4, 2)
    assert tuple(labels.sentence_sizes(tokens.limit(0)).first()) == (0, 0, 0, 0)
    rows = spark.range(5).withColumnRenamed("id", "k")
    extra = rows.where("k < 3").withColumn("f", F.array("k"))
    got = sampling.batches_with_features(rows, "k", extra, 2).collect()
    assert sorted(r["batch"] for r in got) == [0, 0, 1, 1, 2] and {r["k"]: r["f"] for r in got} == {0: [0], 1: [1], 2: [2], 3: None, 4: None}


def test_environment(tmp_path):
    assert environment.current({"HOME": "/h"}).training_documents is None
    test = environment.current({environment.VARIABLE: "1"})
    assert (test.training_documents, test.validation_documents, test.short_sentences) == (4, 2, True)
    assert environment.current({environment.VARIABLE: ""}).name == "development"
    own = environment.Environment("x", tmp_path)
    assert own.path("train") == tmp_path / "data" / "train" == own.path(str(tmp_path / "data" / "train"))
