"""Every registered query of the training-data operators by the columns that it returns, on a whole small table with odd rows."""

import hashlib
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SF, brute_base, brute_components, brute_lm

from maskwright.llm import packing, token_files
from maskwright.llm.queries import ORACLE_SQL, QUERIES
from maskwright.llm.tokens import tokenizer_path


ODD = [None, "", " \t\n", "a", "password: xK93jf8Qz2Lp!", "same words in two rows", "same words in two rows", "x " * 5000, "Ünï ÇØdé 漢字", "!!! ???"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with odd documents and vectors, extra columns named like outputs, and ids beyond the others."""
    out = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10_000_000 + i, t, None if i % 2 else "en", "s", 0) for i, t in enumerate(ODD)], docs.schema)
    clash = ("score", "label", "spans", "start", "ids", "length", "bucket", "key", "levels", "rest", "n_shingles", "class", "t", "held_out", "predicted")
    docs.unionByName(more).withColumns({c: F.lit("clash") for c in clash}).write.parquet(f"{out}/documents.parquet")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = spark.createDataFrame([(10_000_000, None, 0), (10_000_001, [0.0] * 64, 0), (10_000_002, [float("nan")] * 64, 0), (10_000_003, [2.0] * 64, 0), (10_000_004, [3.0] * 64, 0)], vectors.schema)
    vectors.unionByName(odd).withColumns({c: F.lit("clash") for c in ("id", "h", "g")}).write.parquet(f"{out}/embeddings.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").withColumn("extra", F.lit(1)).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def texts(spark, tables):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name, tables):
    return QUERIES[name](spark, tables).collect()


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


@pytest.mark.parametrize(("name", "column", "mod", "rest", "least"), [("op1_quality", "quality", 4, 2, 0.7), ("op8_toxicity", "toxic", 5, 0, 0.5)])
def test_scores(spark, tables, texts, name, column, mod, rest, least):
    rows = rows_of(spark, name, tables)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["held_out"] == held(r["doc_id"], mod, rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in rows)
    known = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    own = [r["predicted"] == known[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in known]
    assert np.mean(own) > 0.8


def test_held_out_labels_are_not_read(spark, tables, tmp_path):
    """Turning the held-out labels round changes no score."""
    for name, mod, rest in (("op1_quality", 4, 2), ("op8_toxicity", 5, 0)):
        other = f"file://{tmp_path}/{name}"
        spark.read.parquet(f"{tables}/documents.parquet").write.parquet(f"{other}/documents.parquet")
        turned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest
        labels = spark.read.parquet(f"{tables}/labels.parquet")
        labels.withColumns({c: F.when(turned, 1 - F.col(c)).otherwise(F.col(c)).cast(labels.schema[c].dataType) for c in ("quality", "toxic")}).write.parquet(f"{other}/labels.parquet")
        score = lambda d, n=name: {r["doc_id"]: r["score"] for r in rows_of(spark, n, d)}
        assert score(tables) == score(other)


def test_token_files(spark, tables, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(token_files.TOKENIZER))
    start = 0
    rows = {r["doc_id"]: r for r in rows_of(spark, "op2_token_files", tables)}
    assert set(rows) == set(texts)
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_language(spark, tables, texts):
    rows = {r["doc_id"]: r for r in rows_of(spark, "op3_language", tables)}
    assert set(rows) == set(texts) and all(r["held_out"] == held(i, 4, 2) and 0 <= r["score"] <= 1 for i, r in rows.items())
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[i] or "")) for i, r in rows.items())
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang").collect()}
    assert np.mean([r["lang_pred"] == lang[i] for i, r in rows.items() if r["held_out"] and lang[i] and i < 10_000_000]) > 0.9


def test_vector_links(spark, tables):
    data = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()}
    sound = {i: np.array(v, float) / np.linalg.norm(v) for i, v in data.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(sound)
    near = np.stack([sound[i] for i in ids]) @ np.stack([sound[i] for i in ids]).T >= 0.95
    want = dict(zip(ids, (near.sum(1) - 1).tolist(), strict=True))
    rows = {r["vec_id"]: r for r in rows_of(spark, "op4_multi_index", tables)}
    assert set(rows) == set(data) and all(r["kept"] == (i == r["component_id"]) for i, r in rows.items())
    assert all(rows[i]["n_links"] <= want.get(i, 0) for i in data) and sum(r["n_links"] for r in rows.values()) >= 0.9 * sum(want.values())
    assert rows[10_000_004]["component_id"] == 10_000_003 and rows[10_000_002]["n_links"] == 0


def test_secrets(spark, tables, texts):
    rows = {r["doc_id"]: r for r in rows_of(spark, "op5_secrets", tables)}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        base = brute_base(texts[i] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert tuple(r[f"n_{k}"] for k in ("assign", "access", "hex")) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("guess")] == (line.split(",") if line else [])
        assert len(spans) - len(base) == r["n_guess"]
    assert rows[10_000_004]["spans"] == "assign:0:22,guess:10:22"


def test_decontamination_sql(spark, tables):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"create view {name} as select * from '{tables.removeprefix('file://')}/{name}.parquet/*.parquet'")
    rel = duck.sql(ORACLE_SQL["op6_decontamination"])
    rows = rows_of(spark, "op6_decontamination", tables)
    key = lambda r: tuple(round(x, 9) for x in r)
    assert sorted(key([r[c] for c in rel.columns]) for r in rows) == sorted(map(key, rel.fetchall())) and rows


def test_packing(spark, tables, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(packing.TOKENIZER))
    rows = rows_of(spark, "op7_packing", tables)
    own, places = {}, {}
    for r in rows:
        own.setdefault(r["doc_id"], {})[r["piece"]] = r
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(own) == set(texts)
    total = 0
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        cut = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        assert [(p["start"], p["length"], p["ids_crc32"]) for _, p in sorted(own[i].items())] == [(2048 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.01 * -(-total // 2048) + 1


def test_parity_join(spark, tables, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(spark, "op9_parity_join", tables)}
    assert got == brute_components(sorted(texts.items()), 3, Fraction(9, 10))


def test_language_model(spark, tables, texts):
    want, total = brute_lm(sorted(texts.items()), lambda i: not held(i, 7, 2))
    rows = rows_of(spark, "op10_bloom_lm", tables)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        n, known, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"], 7, 2), n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
