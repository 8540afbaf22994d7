"""Scoring tokens cut from Arrow batches, and labels of documents with and without spans."""

import random
import re

from maskwright.functions import segments
from maskwright.functions import text as T
from maskwright.operators import spans
from maskwright.plans import queries


def _texts():
    r = random.Random(5)
    made = ["".join(r.choice("ab9Z .,!?\n\t\r\u00e9\u4e2d\U0001f600") for _ in range(r.randrange(40))) for _ in range(300)]
    return [(i, t) for i, t in enumerate([*made, None, "", "...", "a", "x. " * 600, "\u00e9"])]


def test_segments_equal_regular_expressions(spark, monkeypatch):
    texts = _texts()
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    got = sorted(tuple(r) for r in T.scorer_tokens(docs, "text", "doc_id").collect())
    want = []
    for i, t in texts:
        t = t or ""
        m = list(re.finditer("[A-Za-z0-9]+", t))
        cuts = [(x.start(), x.end()) for x in m] or [(len(t), len(t))]
        for k, (a, b) in enumerate(cuts):
            want.append((i, k, t[a:b], t[cuts[k - 1][1] if k else 0 : a], t[b : cuts[k + 1][0] if k + 1 < len(cuts) else len(t)], a, b))
    assert got == sorted(want)
    rows = sorted(tuple(r) for r in T.scorer_sentences(docs, "text", "doc_id", most=7, columns=("token",)).collect())
    want, words = [], {}
    for i, t in texts:
        sent, end = 0, 0
        for k, x in enumerate(re.finditer("[A-Za-z0-9]+", t or "")):
            sent += k > 0 and (bool(re.search(T.SENTENCE_END, t[end : x.start()])) or k % 7 == 0)
            end = x.end()
            want.append((i, sent, k, x[0]))
            words.setdefault((i, sent), []).append(x[0])
    assert rows == sorted(want)
    assert {(r[0], r[1]): r[2] for r in T.scorer_sentence_words(docs, "text", "doc_id", most=7).collect()} == words


def test_tokens_of_documents_without_spans_are_not_exchanged(spark):
    texts = [(1, "mail me at x.y@abc.com or at b@c.de now"), (2, "nothing here"), (3, ""), (1, "again b@c.de"), (None, "b@c.de"), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    gold = spans.detect(docs, {"EMAIL": queries.GOLD["EMAIL"]}, {"EMAIL": "@"})
    assert sorted(gold.collect(), key=str) == sorted(spans.detect(docs, {"EMAIL": queries.GOLD["EMAIL"]}).collect(), key=str)
    parts = []

    def cut(some):
        parts.append(sorted(r["doc_id"] or 0 for r in some.collect()))
        return queries._one_sentence(some)

    got = spans.labelled_tokens(docs, gold, cut)
    assert parts == [[1, 1], [0, 2, 3, 4]]
    want = spans.bio_align(queries._one_sentence(docs), gold)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_case_feature_is_one_class(spark):
    words = ["", "12", "1a2", "abc", "ABC", "Abc", "a1c", "\u00e9", "\u01c5a", "--", "1\u0661"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(T.case_class("w").alias("c"), T.case_feature("w").alias("f")).collect()
    assert [r["c"] for r in rows] == [0, 1, 2, 3, 4, 5, 3, 3, 0, 0, 6]
    assert [r["f"] for r in rows] == [[int(i == r["c"]) for i in range(7)] for r in rows]


def test_classes_of_cut_tokens_are_those_of_their_text(spark):
    texts = ["", "--", "12 1a2 abc ABC Abc aBc a1c A1 1A A12 ab12 Ab1 A a 1", "\u00e9Ab \u01c5a9 x", None, "Z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = T.scorer_tokens(docs, "text", "doc_id", columns=("idx", "token", "case"))
    rows = got.select("case", T.case_class("token").alias("want"), T.class_features("case", ["case", "useless_one"]).alias("f"), T.features("token", ["case", "useless_one"]).alias("g")).collect()
    assert len(rows) == 22 and all(r["case"] == r["want"] and r["f"] == r["g"] for r in rows)


def test_portions_hold_long_texts_alone(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(segments, "PORTION", 5)
    cut = [(a, b, bytes(d)) for a, b, d, _ in segments.portions(pa.array(["ab", "c", None, "d" * 9, "ef"]).slice(1))]
    assert cut == [(0, 2, b"c"), (2, 3, b"d" * 9), (3, 4, b"ef")]


def test_tagger_keeps_labels_and_features_of_whole_sentences(spark):
    import numpy as np

    from maskwright.operators import tagger

    docs = spark.createDataFrame([(1, "Ab 12. cd!\nEf"), (2, "x")], "doc_id int, text string")
    tokens = T.scorer_sentences(docs, "text", "doc_id").withColumnRenamed("token", "text").selectExpr("*", "'O' AS type")
    cut = T.scorer_sentence_words(docs, "text", "doc_id", lists={"places": "idx", "words": "token", "before": "pre_ws", "after": "post_ws"})
    rows = tagger.featured_rows(cut.selectExpr("*", "transform(words, w -> 'O') AS labels"))
    want = tagger.featured(tokens)
    assert sorted(map(str, rows.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    model = tagger.Tagger(["O", "B"], 18, np.zeros((1 << 18, 2)), np.zeros((2, 2)))
    got = tagger.tagged(rows, model, "type").select("doc_id", "sent_idx", "tok_idx", "type", "predicted").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, "O", "O"), (1, 0, 1, "O", "O"), (1, 1, 2, "O", "O"), (1, 2, 3, "O", "O"), (2, 0, 0, "O", "O")]
