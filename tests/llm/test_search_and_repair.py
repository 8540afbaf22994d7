"""Lexical search, conversation repair and nearest neighbours: brute force, SQL, and odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import conversation_repair as cr
from maskwright.llm import lexical_search, prefix_forest
from maskwright.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


# --- 11 lexical search ------------------------------------------------------------------------


def brute_search(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in rows:
            m = 50 + 50 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


SEARCHED = [None, "", " .,", "Apple banana apple", "banana", "APPLE apple_pie Ünï-ÇØdé ÜNÏ", "pear " * 9000, "漢字 apple", "banana", "x1 X1 2"]


def searched(spark, k, monkeypatch, window):
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    rng = random.Random(4)
    vocabulary = ["apple", "banana", "pear", "ünï", "fig", "plum", "x1"]
    docs = list(enumerate(SEARCHED)) + [(rng.choice([3, 3, None, -5000, 9000, 7 * i]), " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for i in range(300)]
    items = [(1, "apple pear"), (2, None), (3, "nothing here"), (4, ""), (5, "Ünï x1 fig fig"), (5, "plum"), (None, "banana")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("clash"), "score": F.lit("clash"), "terms": F.lit("clash")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = sorted((tuple(r) for r in lexical_search.search(d.repartition(3), i, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    return got, brute_search(docs, items, k)


@pytest.mark.parametrize(("k", "window"), [(50, 4096), (3, 8), (400, 64)])
def test_lexical_search(spark, monkeypatch, k, window):
    got, want = searched(spark, k, monkeypatch, window)
    assert got == want and want


def test_lexical_search_in_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 10)
    got, want = searched(spark, 5, monkeypatch, 16)
    assert got == want


def test_lexical_search_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = one.withColumnRenamed("doc_id", "item_id")
    for docs, asked in ((none, items), (one, items.limit(0)), (none, items.limit(0)), (one.select("doc_id", F.lit(None).cast("string").alias("text")), items)):
        found = lexical_search.search(docs, asked)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


def test_windows_are_fixed_ranges(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical_search, "WINDOW", 8)
    ids = [None, None, -9, -1, 0, 7, 8, *[17] * 20]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n": pa.array([1] * len(ids), pa.int64()), "terms": pa.array([[0]] * len(ids), pa.list_(pa.int32())), "tfs": pa.array([[1]] * len(ids), pa.list_(pa.int64()))})
    cut = [w[0] for w in lexical_search.windows(iter([batch.slice(0, 10), batch.slice(10)]))]
    assert cut == [[None, None], [-9], [-1], [0, 7], [8], [17] * 8, [17] * 8, [17] * 4]


# --- 12 conversation repair -------------------------------------------------------------------


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def damage(rows):
    convs = {}
    for c, t, r, x in rows:
        own = convs.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        own.extend([(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for own in convs.values():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.md5(z[2].encode()).hexdigest()))
    return convs


def listed(rows):
    """The cheapest edits by listing all of them: every choice for each row and up to two inserts in each gap."""
    faults = faults_of(rows)
    best = None
    for inserts in itertools.product(*[("", "u", "a", "ua", "au")] * (len(rows) + 1)):
        if sum(map(len, inserts)) > 3:
            continue
        for letters in itertools.product(*["D" if f in ("blank", "duplicate") else ("D", "K", "u", "a") for f in faults]):
            said, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                for c in inserts[k]:
                    said.append(({"u": "user", "a": "assistant"}[c], ""))
                    audit, cost = audit + "I", cost + 5
                if k == len(rows):
                    break
                x, (_, role, text) = letters[k], rows[k]
                cost += {"D": 2, "K": 0}.get(x, 1) + (5 if faults[k] == "truncated" and x != "D" else 0)
                audit += x if x in "DK" else "R"
                if x != "D":
                    said.append(({"u": "user", "a": "assistant"}.get(x, role), text))
            if not re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r else "-" for r, _ in said)):
                continue
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in said))
    return best


def brute_audits(rows):
    out = {}
    for c, own in damage(rows).items():
        faults = faults_of(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, text = listed(own)
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


AUDIT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
CONVERSATION = "conv_id long, turn long, role string, text string"


def odd_conversations():
    rng = random.Random(9)
    said = ["Yes.", "No!", "Why", "Über?", "", " \t", None, "cut off", "Long. " * 50]
    roles = ["user", "assistant", "system", "tool", "", None, "umpire"]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 5, -4]), rng.choice(roles), rng.choice(said)) for c in range(60) for _ in range(rng.randrange(1, 4))]
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (70, 1, "system", "Go."), (70, 2, "user", "Now?"), (70, 3, "assistant", "Yes."), (70, 3, "assistant", "Yes.")]


def audited(spark, rows, monkeypatch, block_rows):
    monkeypatch.setattr(cr, "BLOCK_ROWS", block_rows)
    df = spark.createDataFrame(rows, CONVERSATION).withColumns({c: F.lit("clash") for c in ("copies", "fault", "h", "task", "number", "audit")})
    got = cr.audits(cr.damaged(df.repartition(3))).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r[c] for c in AUDIT) for r in got}


@pytest.mark.parametrize("block_rows", [8192, 1])
def test_repair_equals_all_edits(spark, monkeypatch, block_rows):
    rows = odd_conversations()
    assert audited(spark, rows, monkeypatch, block_rows) == brute_audits(rows)


def test_a_conversation_in_many_blocks_and_tasks(spark, monkeypatch):
    """A third of all rows in one conversation, many of them equal: the same however it is cut."""
    rng = random.Random(2)
    rows = [(5, rng.randrange(400), rng.choice(["user", "assistant", "assistant"]), rng.choice(["Same.", "Same.", f"No {i}.", f"cut {i}"])) for i in range(900)]
    rows += [(5, 7, "user", "Equal.")] * 300 + [(1000 + i, i % 5, "user", "Hm.") for i in range(900)]
    whole = audited(spark, rows, monkeypatch, 100_000)
    cut = audited(spark, rows, monkeypatch, 7)
    assert whole == cut and len(whole[5][6]) > 1000


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 1), (1, 1, "user", "Then?", 1), (2, 0, "user", "", 1), (3, 0, "user", "x.", 0)], CONVERSATION + ", copies int")
    got = [(r["conv_id"], r["role"], r["text"]) for r in cr.repair(rows).orderBy("conv_id", "place").collect()]
    assert got == [(1, "user", "Hi."), (1, "assistant", "Then?")]


def test_repair_of_nothing(spark):
    assert cr.audits(cr.damaged(spark.createDataFrame([], CONVERSATION))).collect() == []


# --- 13 nearest neighbours --------------------------------------------------------------------


def brute_nearest(rows, queries, k):
    own = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in own:
        if not queries(q):
            continue
        best = {}
        for i, w in own:
            if i != q and len(w) == len(v):
                best[i] = max(best.get(i, -np.inf), float((v * w).sum()))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return {q: [(i, -s) for s, i in found] for q, found in out.items()}


def vectors_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit("clash") for c in ("h", "g", "n", "band", "norm", "query", "block", "level")})


def found_of(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([r for r, _, _ in rows] == list(range(1, len(rows) + 1)) for rows in got.values())
    return {q: [(i, s) for _, i, s in rows] for q, rows in got.items()}


def agreement(got, want):
    for q, found in got.items():
        scores = [s for _, s in found]
        assert len(found) == len(want[q]) and scores == sorted(scores, reverse=True)
        assert all(i < j for (i, s), (j, t) in itertools.pairwise(found) if s == t)
    return np.mean([len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) / len(want[q]) for q in want if want[q]])


def test_nearest_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [0.5, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0])]
    rows += [(7, [1.0, 2.0, 3.0]), (40, [1.0, 0.0, 0.0]), (8, []), (None, [1.0, 1.0]), (9, [-1.0, -2.0]), (60, [5000.0, 1.0]), (80, [1.0])]
    got = found_of(prefix_forest.nearest(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, k=3))
    want = {q: v for q, v in brute_nearest(rows, lambda i: i % 20 == 0, 3).items() if v}
    assert set(got) == set(want)
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found] and [s for _, s in got[q]] == pytest.approx([s for _, s in found])


def test_nearest_of_many_copies(spark):
    """More copies of a vector than neighbours are asked for, as queries and as candidates: the least ids, in order."""
    rng = np.random.default_rng(1)
    rows = [(i, [0.6, 0.8, 0.0, 0.0]) for i in range(0, 700, 5)] + [(1000 + i, rng.normal(size=4).tolist()) for i in range(150)]
    got = found_of(prefix_forest.nearest(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, k=20))
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    assert agreement(got, want) >= 0.9
    copies = [i for i in range(0, 700, 5)]
    near = [i for i, s in want[680] if s == want[680][0][1]]
    assert [i for i, _ in got[680]][: len(near)] == near and set(near) <= set(copies) | set(range(1000, 1150))


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "lengths", "offset"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(prefix_forest, "BLOCK", 256)
    monkeypatch.setattr(prefix_forest, "VISITS", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    if kind == "clustered":
        x = rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] + 0.2 * x
    if kind == "lengths":
        x *= np.exp(rng.normal(size=(3000, 1)))
    if kind == "offset":
        x += 2.0
    rows = list(enumerate(x.tolist()))
    got = found_of(prefix_forest.nearest(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, k=20))
    assert agreement(got, brute_nearest(rows, lambda i: i % 20 == 0, 20)) >= 0.9


def test_long_strings_tell_near_copies_apart(spark, monkeypatch):
    """A third of all vectors nearly equal: the calibrated ranges don't hold all of them."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 32))
    x[:500] = x[0] + 0.02 * rng.normal(size=(500, 32))
    rows = list(enumerate(x.tolist()))
    got = found_of(prefix_forest.nearest(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, k=5))
    assert agreement(got, brute_nearest(rows, lambda i: i % 20 == 0, 5)) >= 0.85


def test_nearest_of_nothing(spark):
    none = prefix_forest.nearest(vectors_of(spark, [(1, None)]), F.col("vec_id") % 20 == 0)
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.collect() == []
    assert prefix_forest.nearest(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []


# --- registered queries -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with odd rows, ids beyond the others and extra columns named like outputs."""
    out = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10_000_000 + i, t, None, "s", 0) for i, t in enumerate(SEARCHED)], docs.schema)
    docs.unionByName(more).withColumns({c: F.lit("clash") for c in ("score", "rank", "n", "terms")}).write.parquet(f"{out}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    items.unionByName(spark.createDataFrame([(10_000, "apple banana"), (10_001, None), (0, "apple")], items.schema)).write.parquet(f"{out}/benchmark.parquet")
    talks = spark.read.parquet(f"{SF}/conversations.parquet")
    talks.unionByName(spark.createDataFrame([(10_000 + c if c is not None else None, t, r, x) for c, t, r, x in odd_conversations()], talks.schema)).write.parquet(f"{out}/conversations.parquet")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = spark.createDataFrame([(10_000_000, None, 0), (10_000_020, [0.0] * 64, 0), (10_000_040, [float("nan")] * 64, 0), (10_000_060, [2.0] * 64, 0), (10_000_080, [2.0] * 64, 0)], vectors.schema)
    vectors.unionByName(odd).write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.mark.parametrize(("name", "reads"), [("op11_lexical_search", ("documents", "benchmark")), ("op12_conversation_repair", ("conversations",))])
def test_sql(spark, tables, name, reads):
    duck = duckdb.connect()
    for t in reads:
        duck.sql(f"create view {t} as select * from '{tables.removeprefix('file://')}/{t}.parquet/*.parquet'")
    rel = duck.sql(ORACLE_SQL[name])
    got = [tuple(r[c] for c in rel.columns) for r in QUERIES[name](spark, tables).collect()]
    assert sorted(got, key=repr) == sorted(rel.fetchall(), key=repr) and got


def test_query_of_nearest(spark, tables):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    got = found_of(QUERIES["op13_prefix_forest"](spark, tables))
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want) and agreement(got, want) >= 0.9
    assert got[10_000_060][0] == (10_000_080, 256.0)
