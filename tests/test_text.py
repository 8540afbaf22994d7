from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators import spans


def _tokens(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [r["text"] for r in T.main_tokens(df, "text", "doc_id").where(r"text not rlike '^[ \\n\\t]+$'").orderBy("ord").collect()]


def _sentences(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = T.with_sentences(T.main_tokens(df, "text", "doc_id"), "doc_id")
    return rows.agg(F.countDistinct("sent_idx")).first()[0]


def test_main_tokens(spark):
    assert len(_tokens(spark, "A sentence that is simple to tokenize.")) == 8
    assert len(_tokens(spark, "555-2394-72-01")) == 7
    assert len(_tokens(spark, "a/b")) == 3
    assert len(_tokens(spark, "a_b_c")) == 5
    assert _tokens(spark, "81-year-old") == ["81", "-", "year", "-", "old"]
    assert _tokens(spark, "a^b") == ["a", "^", "b"]
    assert _tokens(spark, "25yo") == ["25", "yo"]


def test_html(spark):
    df = spark.createDataFrame([(1, "NASA &amp; &#62; <br> x")], "doc_id int, text string")
    rows = {r["text"]: r["unescaped"] for r in T.main_tokens(df, "text", "doc_id").collect()}
    assert rows["&amp;"] == "&" and rows["&#62;"] == ">" and rows["<br>"] == "\n" and rows["NASA"] == "NASA"


def test_sentences(spark):
    assert _sentences(spark, "One sentence. And another sentence.") == 2
    assert _sentences(spark, "Here is some text that is followed by many newlines\n \n \n \n \nAnd here is some other text.") == 2
    assert _sentences(spark, "- First list item\n    - and the second list item, which does not look like a start.") == 2
    assert _sentences(spark, "1. test\n        2: ok") == 2
    assert _sentences(spark, "----list with unusual format\n    ----starting with some dashes\n    ---sometimes other dashes") == 6


def test_scorer_tokens(spark):
    docs = spark.createDataFrame([(1, "  ab-c 😀 d9!"), (2, ""), (3, "??"), (4, None)], "doc_id int, text string")
    rows = T.scorer_tokens(docs, "text", "doc_id")
    first = [(r["token"], r["start"], r["end"]) for r in rows.where("doc_id = 1").orderBy("idx").collect()]
    assert first == [("ab", 2, 4), ("c", 5, 6), ("d9", 9, 11)]
    assert [(r["token"], r["start"]) for r in rows.where("doc_id = 3").collect()] == [("", 2)]
    assert [(r["token"], r["start"]) for r in rows.where("doc_id = 2").collect()] == [("", 0)]
    back = {r["doc_id"]: r["text"] for r in T.rendered(rows, "doc_id").collect()}
    assert back[1] == "  ab-c 😀 d9!" and back[3] == "??"


def test_offsets_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (1, "xyz q"), (1, "ab cd")], "doc_id int, text string")
    rows = T.scorer_tokens(docs, "text", "doc_id")
    assert sorted((r["token"], r["start"], r["end"]) for r in rows.collect()) == [("ab", 0, 2)] * 2 + [("cd", 3, 5)] * 2 + [("q", 4, 5), ("xyz", 0, 3)]
    found = T.with_matches(docs, "text", "[a-z]+", "doc_id")
    assert sorted((r["match"], r["start"]) for r in found.collect()) == [("ab", 0)] * 2 + [("cd", 3)] * 2 + [("q", 4), ("xyz", 0)]
    for df in (rows, found):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_running_totals_of_long_texts(spark):
    text = "".join(f"{'w' * (i % 7 + 1)} " for i in range(3 * T.PIECE + 5)) + "😀 z"
    rows = T.scorer_tokens(spark.createDataFrame([(1, text)], "doc_id int, text string"), "text", "doc_id").collect()
    assert len(rows) == 3 * T.PIECE + 6 and all(text[r["start"] : r["end"]] == r["token"] for r in rows)


def test_case_feature(spark):
    words = ["1234", "123a", "ok4y", "OKAY", "Okay", "!4", "", "?!"]
    got = {r["w"]: r["c"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.case_class("w").alias("c")).collect()}
    assert [got[w] for w in words[:5]] == [1, 2, 3, 4, 5] and got[""] == 0 and got["?!"] == 0
    hot = spark.createDataFrame([("OKAY",)], "w string").select(T.features("w", ["case", "useless_one"]).alias("f")).first()["f"]
    assert hot == [0, 0, 0, 0, 1, 0, 0, 1] and T.feature_size(["case", "useless_one"]) == 8


def test_split_sentences(spark):
    words = ["<s>", "</s>", "<s>", "a", "b", "</s>", "<s>", "c", "</s>", "d"]
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "doc_id int, ord int, text string")
    rows = [(r["sent_idx"], r["tok_idx"], r["text"]) for r in T.split_sentences(df).orderBy("ord").collect()]
    assert rows == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]


def test_bio_round_trip(spark):
    text = "Mr John Smith, 81yo, seen 2020-01-02."
    docs = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id int, text string")
    found = spark.createDataFrame(
        [(1, "PATIENT", "NAME", 3, 13, "John Smith"), (1, "AGE", "AGE", 15, 17, "81"), (1, "DATE", "DATE", 26, 36, "2020-01-02"), (1, "DATE", "DATE", 5, 5, "")],
        "doc_id int, tag_type string, tag_name string, start int, end int, text string",
    )
    tokens = T.with_sentences(T.main_tokens(docs, "text", "doc_id"), "doc_id").select("doc_id", "sent_idx", "tok_idx", "text", "start", "end")
    bio = spans.bio_align(tokens, found)
    labels = [r["type"] for r in bio.where("doc_id = 1").orderBy("start").collect()]
    assert labels == ["O", "B-PATIENT", "I-PATIENT", "O", "B-AGE", "O", "O", "O", "B-DATE", "I-DATE", "I-DATE", "I-DATE", "I-DATE", "O"]
    assert bio.where("doc_id = 2 and type <> 'O'").count() == 0  # a document without spans is all O
    back = {(r["tag_type"], r["start"], r["end"]) for r in spans.bio_to_spans(bio).collect()}
    assert back == {("PATIENT", 3, 13), ("AGE", 15, 17), ("DATE", 26, 36)}
    assert [r["reason"] for r in spans.violations(found).collect()] == ["no length"]


def test_stray_inside_opens(spark):
    rows = [(1, 0, 0, "a", 0, 1, "I-DATE"), (1, 0, 1, "b", 2, 3, "I-AGE"), (1, 0, 2, "c", 4, 5, "I-AGE"), (1, 1, 0, "d", 6, 7, "I-AGE")]
    df = spark.createDataFrame(rows, "doc_id int, sent_idx int, tok_idx int, text string, start int, end int, type string")
    got = sorted((r["tag_type"], r["start"], r["end"]) for r in spans.bio_to_spans(df).collect())
    assert got == [("AGE", 2, 5), ("AGE", 6, 7), ("DATE", 0, 1)]


def test_masking_and_merging(spark):
    docs = spark.createDataFrame([(1, "ab cd ef"), (2, "xy")], "doc_id int, text string")
    found = spark.createDataFrame([(1, "AGE", 0, 2), (1, "DATE", 1, 5), (1, "AGE", 6, 8)], "doc_id int, tag_type string, start int, end int")
    assert {r["doc_id"]: r["text"] for r in spans.masked(docs, found).collect()} == {1: "[AGE] [AGE]", 2: "xy"}
    assert {r["doc_id"]: r["text"] for r in spans.masked(docs, found, "<", ">", show_text=True).collect()}[1] == "<ab cd> <ef>"


def test_bullets_and_newlines(spark):
    df = spark.createDataFrame([("a\n\nb", "- x"), ("a", "o")], "t string, b string")
    rows = df.select(T.newlines("t").alias("n"), T.is_bullet("b").alias("b")).collect()
    assert [(r["n"], r["b"]) for r in rows] == [(2, True), (0, True)]
