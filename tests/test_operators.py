import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import augment, evaluation, labels, sampling, tags, vectors
from maskwright.plans.registry import QUERIES
from maskwright.schemas import labels as label_list
from maskwright.schemas import label_index, phi_types
from maskwright.sources import config, sinks, standoff, token_files
from maskwright.storage import stored

SPAN = "doc_id string, tag_type string, tag_name string, start int, end int, text string"


def _sides(spark):
    docs = spark.createDataFrame([("1", "call 555-1234 or John"), ("2", "none")], "doc_id string, text string")
    gold = spark.createDataFrame([("1", "PHONE", "CONTACT", 5, 13, "555-1234"), ("1", "PATIENT", "NAME", 17, 21, "John")], SPAN)
    system = spark.createDataFrame([("1", "PHONE", "CONTACT", 5, 12, "555-123"), ("1", "DOCTOR", "NAME", 17, 21, "John"), ("9", "AGE", "AGE", 0, 1, "x")], SPAN)
    return docs, gold, system


def test_variants():
    names = [v.name for v in evaluation.variants()]
    assert len(names) == 42 == len(set(names)) and names[:3] == ["Token", "Strict", "Relaxed"] and names[-1] == "OTHER HIPAA Strict"


def test_self_evaluation_is_perfect(spark):
    docs, gold, _ = _sides(spark)
    found = evaluation.counts(docs, gold, gold)
    rows = evaluation.micro(found).collect()
    assert all(r["f1"] == (1.0 if r["tp"] else 0.0) and r["fp"] == r["fn"] == 0 for r in rows) and sum(r["tp"] > 0 for r in rows) == 18


def test_counts(spark):
    docs, gold, system = _sides(spark)
    got = {r["variant"]: (r["tp"], r["fp"], r["fn"]) for r in evaluation.micro(evaluation.counts(docs, gold, system)).collect()}
    assert got["Strict"] == (0, 2, 2) and got["Relaxed"] == (1, 1, 1)
    assert got["Token"] == (1, 2, 2)  # 555 agrees; 123 and the doctor don't
    assert got["Binary Strict"] == (1, 1, 1) and got["HIPAA Strict"] == (0, 1, 2) and got["CONTACT Token"] == (1, 1, 1)


def test_every_variant_has_a_row(spark):
    docs, gold, system = _sides(spark)
    found = evaluation.counts(docs, gold, system)
    rows = {r["variant"]: r for r in evaluation.micro(found).collect()}
    assert set(rows) == {v.name for v in evaluation.variants()} and (rows["AGE Token"]["tp"], rows["AGE Token"]["f1"]) == (0, 0.0)
    assert {r["variant"] for r in evaluation.macro(found, docs).collect()} == set(rows)
    empty = evaluation.micro(evaluation.counts(docs, gold.limit(0), system.limit(0))).collect()
    assert len(empty) == 42 and all(r["tp"] == r["fp"] == r["fn"] == 0 for r in empty)


def test_one_row_for_each_document_however_sides_are_exchanged(spark):
    """Sides of unlike size, whose partitions Spark reads in other numbers: spans that one side alone has still meet in one row of the document."""
    docs = spark.range(500).selectExpr("cast(id AS string) AS doc_id", "repeat('word ', 62) AS text")
    spans = docs.selectExpr("doc_id", "explode(sequence(0, 29)) AS k").selectExpr("doc_id", "'CONTACT' AS tag_name", "'PHONE' AS tag_type", "5 * k AS start", "5 * k + 4 AS end")
    system = spans.where("start = 0").selectExpr("doc_id", "tag_name", "tag_type", "start + 300 AS start", "end + 300 AS end")
    few = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in few}
    try:
        for k, value in few.items():
            spark.conf.set(k, value)
        which = [v for v in evaluation.variants() if v.name in ("Strict", "Relaxed", "Token")]
        got = [tuple(r) for r in evaluation.counts(docs, stored(spans, "gold"), stored(system, "system"), which).select("variant", "doc_id", "tp", "fp", "fn").collect()]
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    assert sorted(got) == sorted((v, str(d), 0, 1, 30) for v in ("Strict", "Relaxed", "Token") for d in range(500))


def test_text_differences_and_report(spark):
    gold = spark.createDataFrame([("1", "ab 😀 cd"), ("2", "same"), ("3", None), ("4", "abc"), ("5", "x")], "doc_id string, text string")
    system = spark.createDataFrame([("1", "ab 😀 xd"), ("2", "same"), ("3", None), ("4", "abcdef"), ("6", "x")], "doc_id string, text string")
    got = {r["doc_id"]: (r["n_gold"], r["n_system"], r["first_difference"]) for r in evaluation.text_differences(gold, system).collect()}
    assert got == {"1": (7, 7, 5), "4": (3, 6, 3)}
    docs, g, s = _sides(spark)
    rows = {r["doc_id"]: r.asDict() for r in evaluation.document_report(evaluation.counts(docs, g, g), docs).collect()}
    assert rows["1"]["f1"] == 1.0 and rows["2"] == {"doc_id": "2", "tp": 0, "fp": 0, "fn": 0, "precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_clinical_values(spark):
    rows = [(1, "MEDICATION", "glp1 agonists", "Meglitinides", None), (2, "MEDICATION", "obesity", "", None), (3, "HYPERLIPIDEMIA", None, None, "high-ldl"), (4, "HYPERLIPIDEMIA", None, None, "High-Chol"), (5, "MEDICATION", "glp1 agonist", None, None)]
    df = spark.createDataFrame([(i, n, None, ind, None, a, b) for i, n, a, b, ind in rows], "doc_id int, tag_name string, time string, indicator string, status string, type1 string, type2 string")
    assert [(r["doc_id"], r["value"]) for r in tags.clinical_violations(df).collect()] == [(5, "glp1 agonist")]


def test_macro_counts_documents_without_spans(spark):
    docs, gold, _ = _sides(spark)
    row = evaluation.macro(evaluation.counts(docs, gold, gold, which := [evaluation.Variant("Strict", "tag")]), docs, which).first()
    assert row["precision"] == 0.5 and row["precision_sd"] == 0.5


def test_labels(spark):
    assert len(label_list()) == 64 and len(label_list(hipaa_only=True)) == 38 and label_list(binary=True) == ["O", "O", "B-PATIENT", "I-PATIENT"]
    assert phi_types(spark).where("is_hipaa").count() == 18 and phi_types(spark, hipaa_idnum=True).where("is_hipaa").count() == 19
    tokens = spark.createDataFrame([("O",), ("B-DOCTOR",), ("I-DATE",)], "type string")
    assert [r[0] for r in tokens.select(labels.relabel_binary(labels.relabel_hipaa())).collect()] == ["O", "O", "I-PATIENT"]
    assert labels.with_label_index(tokens, label_index(spark)).where("type = 'O'").first()["ind"] == 1


def test_class_weights(spark):
    rows = spark.createDataFrame([(1,), (1,), (1,), (5,)], "ind int")
    got = {r["ind"]: r["weight"] for r in labels.class_weights(rows, 6).collect()}
    assert got[0] == 0 and got[1] == pytest.approx(4 / 3) and got[5] == 4


def test_word_list(spark):
    rows = [("a", "B-AGE"), ("b", "B-AGE"), ("b", "B-AGE"), ("c", "O"), ("c", "B-AGE"), ("d", "B-AGE"), ("d", "B-AGE"), ("d", "I-AGE"), ("d", "I-AGE")]
    model = labels.word_list_tagger(spark.createDataFrame(rows, "text string, type string"))
    assert {r["word"]: r["label"] for r in model.collect()} == {"a": "O", "b": "B-AGE", "c": "O", "d": "B-AGE"}


def test_word_index(spark):
    vocab = spark.createDataFrame([("word", 2), ("x0", 3), ("<unk>", 1)], "word string, ind int")
    words = spark.createDataFrame([("word",), ("Word",), ("wo-rd",), ("X99",), ("zzz",)], "word string")
    assert {r["word"]: r["ind"] for r in labels.word_index(words, vocab).collect()} == {"word": 2, "Word": 2, "wo-rd": 2, "X99": 3, "zzz": 1}


def test_upper_bound_and_priors(spark):
    schema = "doc_id int, sent_idx int, tok_idx int, text string, type string"
    known = spark.createDataFrame([(1, 0, 0, "Hi", "O"), (1, 0, 1, "Jo", "B-PATIENT")], schema)
    new = spark.createDataFrame([(7, 0, 0, "Hi", None), (7, 0, 1, "Jo", None), (7, 1, 0, "Hm", None)], schema)
    got = [r["predicted"] for r in labels.predict_upper_bound(new, known).orderBy("sent_idx", "tok_idx").collect()]
    assert got == ["O", "B-PATIENT", None]
    assert labels.predict_by_priors(new, labels.label_priors(known)).count() == 3


def test_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 2.0]), (4, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    top = vectors.top_neighbours(v.where("id = 1"), v, 10).orderBy("rank").collect()
    assert [r["id"] for r in top] == [1, 4, 2, 3] and top[2]["similarity"] == pytest.approx(0.8)
    assert [r["id"] for r in vectors.top_neighbours(v.where("id = 1"), v, 2, "l2", include_self=False).orderBy("rank").collect()] == [4, 2]
    blocks = vectors._by_blocks(v, v, 2, "cosine")
    assert {(r["query"], r["id"]) for r in blocks.collect()} >= {(1, 1), (1, 4), (3, 3), (3, 2)}
    r = {x["id"]: x["rank"] for x in vectors.ranks(vectors.similarities(v.where("id = 1"), v)).collect()}
    assert r == {1: 1, 4: 1, 2: 3, 3: 4}
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.normalised("v")).first()[0] is None


def test_hashed_embedding(spark):
    assert len(vectors.hashed_embedding("x")) == 5 and set(vectors.hashed_embedding("x")) <= {0.5, -0.5}
    assert vectors.with_test_vectors(spark.createDataFrame([("x",)], "word string")).first()["vec"] == vectors.hashed_embedding("x")


def test_missing_vector_is_an_error(spark):
    words, vecs = spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("b", [1.0])], "word string, vec array<double>")
    with pytest.raises(Exception, match="no vector for a"):
        vectors.checked_matrix(words, vecs).collect()


def test_strategies():
    assert augment.parse_strategy("move_to_neighbor-5").amount == 5 and augment.parse_strategy(None) is None
    assert not augment.parse_strategy("random_embedding-2").unit_length and augment.parse_strategy("random_embedding-2-l2").unit_length
    with pytest.raises(ValueError):
        augment.parse_strategy("other")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_blocks_order_copies_by_id(spark, monkeypatch, metric):
    """Products of whole blocks differ in last digits by place, so copies came in any order."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 37))
    df = spark.createDataFrame([(i, x[i % 40].tolist()) for i in range(400)] + [(400, [0.0] * 37)] * (metric == "cosine"), "id long, vec array<double>")
    want = [tuple(r) for r in vectors.top_neighbours(df, df, 13, metric).where("similarity is not null").orderBy("query", "rank").collect() if r["query"] < 400]
    monkeypatch.setattr(vectors, "NATIVE_PAIRS", 0)
    monkeypatch.setattr(vectors, "BLOCK", 48)
    monkeypatch.setattr(vectors, "BROADCAST_VECTORS", 150)
    got = [tuple(r) for r in vectors.top_neighbours(df, df, 13, metric).orderBy("query", "rank").collect()]
    assert [g[:3] for g in got] == [w[:3] for w in want] and got == want


def test_ranks_without_exchange_of_pairs(spark):
    rng = np.random.default_rng(5)
    x = [*rng.normal(size=(30, 7)).tolist() * 3, [0.0] * 7, None]
    df = spark.createDataFrame(list(enumerate(x)), "id long, vec array<double>").repartition(3)
    some = df.where("id % 10 = 0 or id > 89")
    want = sorted(tuple(r) for r in vectors.ranks(vectors.similarities(some, df)).select("query", "id", "rank").collect())
    found = vectors.cosine_ranks(some, df)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) == 11 * 92
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pseudonyms(spark):
    schema = "doc_id int, sent_idx int, tok_idx int, text string, eligible boolean"
    rows = spark.createDataFrame([(1, 0, 0, "a", True), (1, 0, 1, "a", True), (1, 0, 2, "z", False), (2, 0, 0, "z", False)], schema)
    options = spark.createDataFrame([("a", ["b", "c"]), ("z", ["q"])], "word string, options array<string>")
    out = augment.pseudonyms(rows, options, alternatives=3, consistent=True).collect()
    assert len(out) == 9 and len({r["new_text"] for r in out if r["text"] == "a"}) == 1 and all(r["new_text"] == "z" for r in out if r["text"] == "z")
    assert sum(r["take"] for r in augment.pseudonyms(rows, options, most=1).collect()) == 1


def test_batches(spark):
    rows = spark.createDataFrame([(i,) for i in range(3)], "id int")
    assert sorted(r["count"] for r in sampling.batches(rows, "id", 2).groupBy("batch").count().collect()) == [1, 2]
    assert sampling.batches(rows, "id", 2, keep_tail=False).count() == 2
    assert sampling.compounding(1, 20, 1.1, 100)[-1] == 20 and sampling.compounding(1, 20, 1.1, 8) == [1, 1, 1, 1, 1, 1, 1, 1]


def test_stratified(spark):
    rows = spark.createDataFrame([(i, i < 80) for i in range(100)], "id int, p boolean")
    out = sampling.stratified_batches(rows, "id", F.col("p"), 6).groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("int")).alias("p")).orderBy("batch").collect()
    assert len(out) == 7 and [r["n"] for r in out] == [6] * 6 + [4] and all(r["p"] * 2 == r["n"] for r in out)


def test_split(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)], "id int")
    got = {r["split"]: r["count"] for r in sampling.split_train_validation(rows, "id", 0.4, 0.25).groupBy("split").count().collect()}
    assert got == {"validation": 5, "train": 15}


def test_filters(spark):
    with pytest.raises(ValueError):
        tags.compile_filter("no such value")
    assert tags.combined([]) is not None


def test_config():
    c = config.Config({"a": {"b": 1}})
    assert c["a"]["b"] == 1 and c["x"] is None and c["model_args"] == {} and c["a"]["zzz"] is None
    spec = {"m": {"x": {"choice": [1, 2]}, "y": 3}, "z": {"choice": ["p", "q"]}}
    assert len(config.grid(spec)) == 4 and config.grid(spec)[0] == {"m": {"x": 1, "y": 3}, "z": "p"}
    assert config.unflatten(config.flatten({"a": {"b": 1}, "c": 2})) == {"a": {"b": 1}, "c": 2}
    assert len(config.drawn(spec, 3)) == 3


XML = """<?xml version="1.0" encoding="UTF-8" ?>
<root>
<TEXT><![CDATA[

Seen 2020 by Jo &lt;3
]]></TEXT>
<TAGS>
<DATE id="P0" start="7" end="11" text="2020" TYPE="DATE" comment="" />
<NAME id="P1" start="15" end="17" text="Jo" TYPE="DOCTOR"/>
<SMOKER id="D0" status="past"></SMOKER>
</TAGS>
</root>
"""


def test_standoff(spark, tmp_path):
    (tmp_path / "110-01sysA.xml").write_text(XML)
    files = standoff.read_files(spark, str(tmp_path))
    doc = standoff.documents(files).first()
    assert doc["doc_id"] == "110-01" and doc["sys_id"] == "sysA" and doc["text"] == "\n\nSeen 2020 by Jo &lt;3\n"
    rows = standoff.tags(files).orderBy("ord").collect()
    assert [(r["tag_name"], r["tag_type"], r["start"], r["comment"]) for r in rows] == [("DATE", "DATE", 7, ""), ("NAME", "DOCTOR", 15, None), ("SMOKER", None, None, None)]
    every = standoff.tags(files)
    assert standoff.phi_tags(every).count() == 2 and standoff.document_level(every).first()["status"] == "past" and standoff.annotator_level(every).count() == 0


def test_xml_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("1-1", "a \"b\" <c>\nJo"), ("1-2", "no tags")], "doc_id string, text string")
    found = spark.createDataFrame([("1-1", "PATIENT", 2, 5), ("1-1", "DOCTOR", 10, 12)], "doc_id string, tag_type string, start int, end int")
    for r in sinks.to_xml(docs, found).collect():
        (tmp_path / f"{r['doc_id']}.xml").write_text(r["xml"])
    files = standoff.read_files(spark, str(tmp_path))
    assert {r["doc_id"]: r["text"] for r in standoff.documents(files).collect()} == {"1-1": "a \"b\" <c>\nJo", "1-2": "no tags"}
    assert [(r["id"], r["tag_type"], r["start"], r["text"]) for r in standoff.tags(files).orderBy("ord").collect()] == [("P0", "PATIENT", 2, '"b"'), ("P1", "DOCTOR", 10, "Jo")]


def test_token_csv(spark, tmp_path):
    (tmp_path / "1-1.csv").write_text('text,type,start,end\n<s>,O,0,0\nJo,B-PATIENT,0,2\n",",O,2,3\n</s>,O,2,3\n')
    (tmp_path / "1-2.csv").write_text("text,type,start,end\n<s>,O,0,0\nx,O,0,1\n</s>,O,0,1\n")
    rows = token_files.read_token_csv(spark, str(tmp_path), limit=1).orderBy("ord").collect()
    assert [r["text"] for r in rows] == ["<s>", "Jo", ",", "</s>"] and rows[0]["doc_id"] == "1-1"


def test_word_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a 3 4\nb 0 1\n")
    rows = token_files.read_word_vectors(spark, str(tmp_path / "v.txt")).orderBy("ind").collect()
    assert [(r["word"], r["ind"]) for r in rows] == [("a", 2), ("b", 3)] and rows[0]["vec"] == pytest.approx([0.6, 0.8])
    (tmp_path / "w.txt").write_text("a 3 4\na 0 1\n")
    with pytest.raises(ValueError):
        token_files.read_word_vectors(spark, str(tmp_path / "w.txt"))


def test_features_of_every_token(spark, tmp_path):
    texts = [(1, " ".join(f"w{i}" for i in range(25)) + " 7"), (2, "a b"), (3, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r["doc_id"], r["idx"]): (r["is_number"], r["is_one"], r["size"]) for r in QUERIES["feature_vectors"](spark, str(tmp_path)).collect()}
    assert rows == {(1, i): (0, 1, 8) for i in range(25)} | {(1, 25): (1, 1, 8), (2, 0): (0, 1, 8), (2, 1): (0, 1, 8), (3, 0): (0, 1, 8)}


def test_growing_batches_hold_every_row(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["compounding_batches"](spark, str(tmp_path)).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 1000
    order = sorted(range(1000), key=lambda i: (hashlib.md5(f"{i}|0".encode()).hexdigest(), i))
    left, expected = iter(order), {}
    for batch in range(1000):
        for place in range(int(min(1.1**batch, 20))):
            if (i := next(left, None)) is not None:
                expected[i] = (batch, place)
    assert {r["doc_id"]: (r["batch"], r["place"]) for r in rows} == expected
    with pytest.raises(ValueError):
        sampling.compounding_sizes(spark, 1, 20, 1.0)


def test_cosine_ranks_exchange_no_pairs(spark, monkeypatch):
    """Whatever a task may hold; repeated ids, equal, zero and null vectors among them.  Only queries are exchanged, before they meet vectors."""
    rng = np.random.default_rng(2)
    vecs = [rng.normal(size=4).tolist() for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(0, vecs[1]), (31, vecs[3]), (32, [0.0] * 4), (33, None), (50, None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    queries = df.where("id % 10 = 0")
    want = sorted(map(tuple, vectors.ranks(vectors.similarities(queries, df)).select("query", "id", "rank").collect()))
    for held in (1, 700, 1 << 20):
        monkeypatch.setattr(vectors, "HELD_BYTES", held)
        found = vectors.cosine_ranks(queries, df)
        assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Repartition") and plan.count("MapInArrow") == 1
