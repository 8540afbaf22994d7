"""Every stage of the corpus pipeline on null, empty, repeated, very long and clashing rows, and on an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
ODD = [None, None, "", "", " \t\n", "a", "one two three four five six seven", "one two three four five six seven", "x " * 20_000, "Ünï ÇØdé 漢字", "!!! ???", "password: xK93jf8Qz2Lp!"]
#: Columns named like what operators add.
CLASH = ("score", "label", "spans", "start", "ids", "length", "bucket", "key", "rest", "class", "predicted", "n_shingles", "t", "h")


@pytest.fixture(scope="module")
def docs(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(10_000_000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(10_000_006, ODD[6], None, None, None), (None, "no id at all", None, None, None)], some.schema)
    return some.unionByName(odd).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text").collect()


def own(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is None or r["doc_id"] >= 10_000_000), key=repr)


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontaminate", "secrets"])
def test_filters_keep_columns(spark, docs, rows, name):
    out = STAGES[name](spark, docs, SF)
    assert set(out.columns) == set(docs.columns)
    assert all(r[c] == "clash" for r in out.select(*CLASH).collect() for c in CLASH)
    given = {(r["doc_id"], r["text"]) for r in rows}
    if name != "secrets":
        assert {(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()} <= given


def test_near_duplicates(spark, docs):
    left = own(STAGES["near_duplicates"](spark, docs, SF))
    ids = [i for i, _ in left]
    assert [t for _, t in left].count(None) == 2 and [t for _, t in left].count("") == 2
    assert 10_000_006 in ids and 10_000_007 not in ids and None in ids


def test_decontaminate_keeps_clean_rows(spark, docs):
    assert len(own(STAGES["decontaminate"](spark, docs, SF))) == len(ODD) + 2


def test_secrets(spark, docs, rows):
    out = STAGES["secrets"](spark, docs, SF)
    assert out.count() == len(rows)
    found = {i: t for i, t in own(out)}
    assert found[10_000_000] is None and found[10_000_002] == "" and found[10_000_008] == "x " * 20_000
    assert "xK93jf8Qz2Lp" not in found[10_000_011]


def test_packing(spark, docs, rows):
    out = STAGES["packing"](spark, docs, SF).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in rows}
    assert all(0 < r["length"] <= 2048 for r in out)
    long = sorted(r["piece"] for r in out if r["doc_id"] == 10_000_008)
    assert long == list(range(len(long))) and len(long) > 5


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, docs, name):
    assert STAGES[name](spark, docs.where("false"), SF).count() == 0
